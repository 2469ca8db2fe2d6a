"""Sliding sums, embeddings and means over positions; all count frames, complete ones only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raywalk.functions import scalars
from raywalk.operators.chunks import CHUNK, frame, own_rows, with_halo


def sliding_sum(series: DataFrame, width: int, value: str = "value", out: str = "conv", chunk: int = CHUNK) -> DataFrame:
    """``idx`` and the sum of ``width`` values from there on. The last complete frame is left out, as a sum
    is only made once a further record is there: a series of N records has N - width sums."""
    rows = with_halo(series, chunk, after=width)
    rows = rows.select("chunk", "idx", F.sum(value).over(frame(0, width - 1)).alias(out), F.count("*").over(frame(0, width)).alias("_n"))
    return own_rows(rows.where(F.col("_n") == width + 1), chunk).select("idx", out)


def sliding_sum_prefix(series: DataFrame, width: int, value: str = "value", out: str = "conv", chunk: int = CHUNK) -> DataFrame:
    """``sliding_sum`` from differences of running sums inside the chunk: the work per row doesn't depend on the width."""
    rows = with_halo(series, chunk, after=width)
    order = Window.partitionBy("chunk").orderBy("idx")
    rows = rows.withColumn("_total", F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.select("chunk", "idx", (F.lead("_total", width - 1).over(order) - F.col("_total") + F.col(value)).alias(out), F.lead("idx", width).over(order).alias("_next"))
    return own_rows(rows.where("_next IS NOT NULL"), chunk).select("idx", out)


def lag_embedding(conv: DataFrame, width: int, value: str = "conv", out: str = "row", chunk: int = CHUNK) -> DataFrame:
    """``idx`` and the ``width`` values from there on as an array: rows of the Hankel matrix."""
    rows = with_halo(conv, chunk, after=width - 1)
    rows = rows.select("chunk", "idx", F.collect_list(value).over(frame(0, width - 1)).alias(out))
    return own_rows(rows.where(F.size(out) == width), chunk).select("idx", out)


def lead_pairs(points: DataFrame, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """Each row with ``next_`` columns of the following row; the last row has none and is left out."""
    rows = with_halo(points, chunk, after=1)
    order = Window.partitionBy("chunk").orderBy("idx")
    rows = rows.select("*", F.lead("idx").over(order).alias("_next"), *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return own_rows(rows.where("_next IS NOT NULL"), chunk).drop("_next")


def sliding_ratio(rows: DataFrame, above: str, below: str, length: int, out: str = "score", idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """Sum of ``above`` over sum of ``below`` in complete frames of ``length`` rows."""
    halo = with_halo(rows, chunk, after=length - 1, idx=idx)
    f = frame(0, length - 1, idx)
    halo = halo.select("chunk", idx, F.try_divide(F.sum(above).over(f), F.sum(below).over(f)).alias(out), F.lead(idx, length - 1).over(Window.partitionBy("chunk").orderBy(idx)).alias("_end"))
    return own_rows(halo.where("_end IS NOT NULL"), chunk, idx).select(idx, out)


def sliding_ratio_prefix(rows: DataFrame, above: str, below: str, length: int, out: str = "score", idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """``sliding_ratio`` from differences of running sums inside the chunk; exact for integers."""
    halo = with_halo(rows, chunk, after=length - 1, idx=idx)
    order = Window.partitionBy("chunk").orderBy(idx)
    totals = halo.withColumns({f"_{c}": F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in (above, below)})
    part = lambda c: F.lead(f"_{c}", length - 1).over(order) - F.col(f"_{c}") + F.col(c)
    halo = totals.select("chunk", idx, F.try_divide(part(above), part(below)).alias(out), F.lead(idx, length - 1).over(order).alias("_end"))
    return own_rows(halo.where("_end IS NOT NULL"), chunk, idx).select(idx, out)


def running_mean(rows: DataFrame, value: str, length: int, out: str, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """Mean of complete frames of ``length`` rows."""
    halo = with_halo(rows, chunk, after=length - 1, idx=idx)
    f = frame(0, length - 1, idx)
    halo = halo.select("chunk", idx, F.avg(value).over(f).alias(out), F.count("*").over(f).alias("_n"))
    return own_rows(halo.where(F.col("_n") == length), chunk, idx).select(idx, out)


def running_mean_prefix(rows: DataFrame, value: str, length: int, out: str, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """``running_mean`` from differences of running sums inside the chunk."""
    halo = with_halo(rows, chunk, after=length - 1, idx=idx)
    order = Window.partitionBy("chunk").orderBy(idx)
    halo = halo.withColumn("_total", F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    halo = halo.select("chunk", idx, ((F.lead("_total", length - 1).over(order) - F.col("_total") + F.col(value)) / length).alias(out))
    return own_rows(halo.where(F.col(out).isNotNull()), chunk, idx).select(idx, out)


def min_max(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.min(value).alias("least"), F.max(value).alias("most"))


def normalised(rows: DataFrame, value: str, out: str) -> DataFrame:
    """(most - value) / (most - least) over all rows; 0 where all are equal. One small aggregate is broadcast."""
    ends = min_max(rows, value)
    scaled = scalars.min_max_scaled(F.col(value), F.col("least"), F.col("most"))
    return rows.join(F.broadcast(ends)).withColumn(out, scaled).drop("least", "most")
