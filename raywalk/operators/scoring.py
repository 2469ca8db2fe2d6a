"""Scores of paths through the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raywalk.operators.chunks import CHUNK
from raywalk.operators.graph import ENDS, edges, node_degrees
from raywalk.operators.windows import normalised, running_mean, sliding_ratio, sliding_ratio_prefix


def slot_summands(events: DataFrame, edge_rows: DataFrame | None = None) -> DataFrame:
    """``transition``, ``summands`` (weight * (degree of the first node - 1), added up) and ``edges``, the number of its events.

    A graph has at most (segments * grid / 2)**2 edges, whatever the series' length; Spark broadcasts or
    shuffles it by its size."""
    edge_rows = edge_rows if edge_rows is not None else edges(events)
    degrees = node_degrees(edge_rows).withColumnsRenamed({"segment": "from_segment", "node": "from_node"})
    worth = edge_rows.join(degrees, ["from_segment", "from_node"]).select(*ENDS, (F.col("weight") * (F.col("degree") - 1)).alias("summand"))
    return events.join(worth, ENDS).groupBy("transition").agg(F.sum("summand").alias("summands"), F.count("*").alias("edges"))


def path_scores(slots: DataFrame, query: int, chunk: int = CHUNK, running: bool = False) -> DataFrame:
    """``start_idx`` and ``score`` of every path of ``query`` slots: its summands over its number of edge events. ``running``: from running sums."""
    rows = slots.withColumnRenamed("transition", "start_idx")
    return (sliding_ratio_prefix if running else sliding_ratio)(rows, "summands", "edges", query, "score", "start_idx", chunk)


def anomaly_scores(paths: DataFrame, length: int, chunk: int = CHUNK) -> DataFrame:
    """``start_idx`` and ``anomaly_score``: running means of min-max normalised, inverted path scores; higher is stranger."""
    return running_mean(normalised(paths, "score", "z"), "z", length, "anomaly_score", "start_idx", chunk)


def top_anomalies(scores: DataFrame, k: int) -> DataFrame:
    """The k highest scores, ties to smaller positions (an addition to the pipeline)."""
    return scores.orderBy(F.desc("anomaly_score"), "start_idx").limit(k)
