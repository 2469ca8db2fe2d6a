"""Distributed principal components of the embedding: partial sums in tasks, a width x width matrix on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raywalk.operators.chunks import CHUNK, with_halo
from raywalk.operators.numeric import components, hankel, rotation_to_z, scatter, triangular


def column_means(rows: DataFrame, width: int) -> DataFrame:
    """``col`` and ``mean`` over Hankel rows in column ``row``: one aggregate of all columns."""
    means = rows.agg(*(F.avg(F.get("row", F.lit(j))).alias(f"m{j}") for j in range(width)))
    return means.select(F.posexplode(F.array(*(f"m{j}" for j in range(width)))).alias("col", "mean"))


def scatter_matrix(rows: DataFrame, width: int, column: str = "row") -> DataFrame:
    """``i``, ``j`` (i <= j) and the centred cross product ``s`` of an embedding's columns."""
    means = rows.agg(*(F.avg(F.get(column, F.lit(j))).alias(f"m{j}") for j in range(width)))
    centred = rows.join(F.broadcast(means)).select(F.array(*(F.get(column, F.lit(j)) - F.col(f"m{j}") for j in range(width))).alias("c"))
    # a row for each i keeps the aggregate at one sum for each j, within the limits of generated code
    each = centred.select("c", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i"))
    sums = each.groupBy("i").agg(*(F.sum(F.get("c", F.col("i")) * F.get("c", F.lit(j))).alias(f"s{j}") for j in range(width)))
    return sums.select("i", F.posexplode(F.array(*(f"s{j}" for j in range(width)))).alias("j", "s")).where("i <= j")


def principal_components(conv: DataFrame, width: int, means: np.ndarray | None = None, method: str = "scatter", chunk: int = CHUNK, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Column means and the first k components (width x k) of the Hankel rows of ``conv`` (idx, conv).

    ``scatter`` adds up cross products about the first value; ``qr`` stacks R factors of rows about the
    exact means, which costs a pass more and keeps full accuracy for nearly dependent columns."""
    first = conv.where("idx = 0").select("conv").first()
    if first is None:
        raise ValueError("the series is empty")
    shift = float(first[0])
    halo = with_halo(conv, chunk, after=width - 1)

    def own(table: pa.Table) -> np.ndarray:
        order = np.argsort(table["idx"].to_numpy())
        values = table["conv"].to_numpy()[order]
        return hankel(values, width)[:chunk] if len(values) >= width else np.zeros((0, width))

    def part(table: pa.Table) -> pa.Table:
        n, sums, cross = scatter(own(table), shift)
        return pa.table({"n": [n], "sums": [sums.tolist()], "cross": [cross.reshape(-1).tolist()]})

    def add(rows: DataFrame, name: str, size: int) -> list:
        return [F.sum(F.get(name, F.lit(i))).alias(f"{name}{i}") for i in range(size)]

    parts = halo.groupBy("chunk").applyInArrow(part, "n long, sums array<double>, cross array<double>")
    flat = parts.select("n", F.posexplode(F.concat("sums", "cross")).alias("at", "v")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("at").collect()
    n, total = flat[0]["n"], np.array([r["v"] for r in flat])
    sums, cross = total[:width], total[width:].reshape(width, width)
    found = sums / n + shift
    centred = cross - np.outer(sums, sums) / n
    if method == "scatter":
        return found, components(centred, k)
    means = found if means is None else means

    def factor(table: pa.Table) -> pa.Table:
        return pa.table({"r": [triangular(own(table), means).reshape(-1).tolist()]})

    stack = np.zeros((0, width))
    for row in halo.groupBy("chunk").applyInArrow(factor, "r array<double>").toLocalIterator():  # width**2 numbers a chunk, one at a time
        stack = np.linalg.qr(np.vstack([stack, np.array(row["r"]).reshape(-1, width)]), mode="r")
    return found, components(stack, k)


def trajectory_filters(means: np.ndarray, pc: np.ndarray, least: float, convolution: int) -> tuple[np.ndarray, np.ndarray]:
    """Two filters (width x 2) and offsets that take Hankel rows straight to the plane: rows @ filters - offsets.

    The direction of a flat subsequence at the least value is turned to the third axis, which is dropped."""
    ref = (convolution * least - means) @ pc
    turned = pc @ rotation_to_z(ref).T[:, :2]
    return turned, means @ turned
