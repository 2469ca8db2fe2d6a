"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by the given axes (source, language and topic, say). Cell weights start as token counts
and are raked to each axis's target shares in turn. A document's weight is its cell's fitted weight over its
tokens; documents are then drawn by a hash of their key with probability min(1, c * weight), where c is
calibrated so that the expected tokens of the draw are the wanted part of all, whatever is cut at 1.

Counts of the cells reach the driver while there are at most MAX_CELLS. More of them stay in a written table: a fitted
weight is the cell's tokens times one factor for each of its axis values, so only sums along one axis at a time come to the
driver, and the calibration is by sums over the cells. Of an axis with over MAX_CELLS values of its own the call fails rather
than leaving values out. The draw depends on nothing but the key, so it is the same on every run.

Defined results: a null axis value is the cell value ''; null or empty texts have no tokens, and a cell
without tokens keeps weight 1; targets for values that don't occur are left out and the others
scaled up; values without a target share keep nothing (weight 0); a null key draws like the empty text;
repeated rows are drawn together; a column named like a result is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raywalk.llm import shared

MAX_CELLS = 200_000
ROUNDS = 25


def n_words(text: Column) -> Column:
    """Runs of bytes other than 0x20 and 0x09-0x0D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def text_form(text: Column) -> Column:
    """A topic by the form of a text: ``data`` (every 50th character or more is a digit), ``lines`` (lines of under 120 characters on average) or ``prose``."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    digits = size - F.length(F.translate(text, "0123456789", ""))
    lines = size - F.length(F.translate(text, "\n", "")) + 1
    return F.when((digits > 0) & (50 * digits >= size), "data").when(size < 120 * lines, "lines").otherwise("prose")


def uniform(tokens: dict[str, int]) -> dict[str, float]:
    return dict.fromkeys(tokens, 1.0)


def square_root(tokens: dict[str, int]) -> dict[str, float]:
    return {k: float(np.sqrt(n)) for k, n in tokens.items()}


def rake(tokens: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Cell weights whose sums along each axis have the target shares. ``axes``: the value's number of each cell."""
    w, total = tokens.astype(float), float(tokens.sum())
    for _ in range(rounds):
        for of, share in zip(axes, targets):
            have = np.bincount(of, weights=w, minlength=len(share)).astype(float)
            w = w * np.divide(share * total, have, out=np.zeros(len(share)), where=have > 0)[of]
    return w


def calibrate(tokens: np.ndarray, weight: np.ndarray, part: float) -> float:
    """c such that the sum of tokens * min(1, c * weight) is ``part`` of all tokens, or what can be had."""
    order = np.argsort(-weight, kind="stable")
    t, f = tokens[order].astype(float), weight[order]
    cut, rest = np.cumsum(t) - t, np.cumsum((t * f)[::-1])[::-1]
    wanted = part * t.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.where(rest > 0, (wanted - cut) / rest, np.inf)
    good = np.flatnonzero((c * f <= 1) & (rest > 0))
    return float(c[good[0]]) if len(good) else float(1 / f[f > 0].min()) if (f > 0).any() else 0.0


def _along(cells: DataFrame, axis: str, value: Column, limit: int) -> dict[str, float]:
    """Sums of ``value`` for each value of one axis."""
    found = cells.groupBy(axis).agg(F.sum(value).alias("_sum")).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} values of {axis}")
    return {r[0]: r[1] for r in found}


def _times(rows: DataFrame, factors: dict[str, dict[str, float]], to: str) -> DataFrame:
    """Add ``to``, the product of the factors of a row's axis values."""
    spark, product = rows.sparkSession, F.lit(1.0)
    for k, (axis, of) in enumerate(factors.items()):
        table = spark.createDataFrame(list(of.items()), f"`{axis}` string, `_factor{k}` double")
        rows = rows.join(F.broadcast(table), axis)
        product = product * F.col(f"_factor{k}")
    return rows.withColumn(to, product).drop(*(f"_factor{k}" for k in range(len(factors))))


def _rake_cells(cells: DataFrame, names: list[str], targets: dict[str, Callable], part: float, rounds: int, limit: int) -> tuple[dict[str, dict[str, float]], float]:
    """Factors of the axis values, and c, as ``rake`` and ``calibrate`` find them, of ``cells`` (a written table: axes, ``tokens``)."""
    have = {n: _along(cells, n, F.col("tokens"), limit) for n in names}
    total = float(sum(have[names[0]].values()))
    share, factors = {}, {n: dict.fromkeys(have[n], 1.0) for n in names}
    for n in names:
        wanted = targets[n](have[n])
        kept = {v: float(wanted.get(v, 0.0)) if s else 0.0 for v, s in have[n].items()}
        whole = sum(kept.values()) or 1.0
        share[n] = {v: x / whole for v, x in kept.items()}
    for _ in range(rounds):
        for n in names:
            now = _along(_times(cells, factors, "_w"), n, F.col("tokens") * F.col("_w"), limit)
            factors[n] = {v: f * share[n][v] * total / now[v] if now[v] > 0 else 0.0 for v, f in factors[n].items()}
    weighted = _times(cells, factors, "_w").withColumn("_w", F.when(F.col("tokens") > 0, F.col("_w")).otherwise(1.0))
    c, wanted = 0.0, part * total
    while True:  # each turn cuts more cells at 1, until those that are cut are the right ones
        over = F.lit(c) * F.col("_w") > 1
        sums = weighted.agg(F.sum(F.when(over, F.col("tokens")).otherwise(0)).alias("cut"), F.sum(F.when(over, 0.0).otherwise(F.col("tokens") * F.col("_w"))).alias("rest"), F.min(F.when(F.col("_w") > 0, F.col("_w"))).alias("least")).first()
        if not sums["rest"]:
            return factors, 1 / sums["least"] if sums["least"] else 0.0
        after = (wanted - sums["cut"]) / sums["rest"]
        if after <= c * (1 + 1e-12):
            return factors, c
        c = after


def mix(df: DataFrame, axes: dict[str, Column], targets: dict[str, Callable[[dict[str, int]], dict[str, float]]], part: float, tokens: Column | None = None, key: str = "doc_id", rounds: int = ROUNDS, max_cells: int = MAX_CELLS) -> DataFrame:
    """Add the axes, ``n_tokens``, ``weight``, ``prob`` and ``sampled``. ``targets`` gives each axis's shares, in any scale, from its token counts.

    ``tokens`` is the number of a document's tokens, the words of ``text`` by default. The table is read twice, so axes and tokens
    that are dear to compute should be columns of a written table."""
    names = list(axes)
    made = [*names, "n_tokens", "weight", "prob", "sampled"]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in made]
    rows = df.select(*rest, *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in axes.items()), F.coalesce((n_words(F.col("text")) if tokens is None else tokens).cast("long"), F.lit(0).cast("long")).alias("n_tokens"))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    counted = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    cells = counted.limit(max_cells + 1).toPandas()
    if len(cells) > max_cells:
        kept = shared.write_table(counted, "cells")
        factors, c = _rake_cells(kept, names, targets, part, rounds, MAX_CELLS)
        empty = kept.where("tokens = 0").select(*names, F.lit(1.0).alias("_empty"))
        mixed = _times(rows, factors, "weight").join(empty, names, "left").withColumn("weight", F.coalesce("_empty", "weight"))
        mixed = mixed.withColumn("prob", F.least(F.lit(1.0), F.lit(c) * F.col("weight")))
        return mixed.withColumn("sampled", draw < F.col("prob")).select(*rest, *made)
    cells = cells.sort_values(names)
    have = cells["tokens"].to_numpy().astype(np.int64)
    of, shares = [], []
    for n in names:
        values, number = np.unique(cells[n].to_numpy(object).astype(str), return_inverse=True)
        sums = np.bincount(number, weights=have, minlength=len(values)).astype(np.int64)
        wanted = targets[n](dict(zip(values.tolist(), sums.tolist())))
        share = np.array([float(wanted.get(v, 0.0)) if s else 0.0 for v, s in zip(values.tolist(), sums.tolist())])
        of.append(number)
        shares.append(share / share.sum() if share.sum() else share)
    fitted = rake(have, of, shares, rounds)
    weight = np.divide(fitted, have, out=np.ones(len(have)), where=have > 0)
    c = calibrate(have, weight, part) if len(have) else 0.0
    cells = cells.assign(weight=weight, prob=np.minimum(1.0, c * weight))[[*names, "weight", "prob"]]
    spark = df.sparkSession
    schema = ", ".join(f"`{n}` string" for n in names) + ", weight double, prob double"
    table = F.broadcast(spark.createDataFrame([(*map(str, r[:-2]), float(r[-2]), float(r[-1])) for r in cells.itertuples(index=False)], schema))
    return rows.join(table, names, "left").withColumn("sampled", draw < F.col("prob")).select(*rest, *made)
