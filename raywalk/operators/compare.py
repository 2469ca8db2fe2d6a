"""Comparison of two results by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with both values, ``difference`` (absolute) and ``state``: ``both``, ``left`` or ``right``."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    rows = a.join(b, keys, "full_outer")
    state = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return rows.select(*keys, "left_value", "right_value", F.abs(F.col("left_value") - F.col("right_value")).alias("difference"), state.alias("state"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: number compared, largest and mean difference, and numbers that are missing on either side."""
    both = F.col("state") == "both"
    return rows.agg(
        F.count_if(both).alias("compared"), F.max("difference").alias("max_difference"), F.avg("difference").alias("avg_difference"),
        F.count_if(F.col("state") == "left").alias("only_left"), F.count_if(F.col("state") == "right").alias("only_right"),
    )


def score_diff(left: DataFrame, right: DataFrame, value: str = "anomaly_score", key: str = "start_idx") -> DataFrame:
    return summary(differences(left, right, [key], value))


def node_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    return summary(differences(left, right, ["segment", "node"], "radius"))


def matrix_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    return summary(differences(left, right, ["row", "col"], "value"))
