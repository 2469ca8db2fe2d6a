"""From crossings to a weighted transition graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raywalk.operators.chunks import CHUNK, carried


def match_nodes(crossings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Crossings with the nearest ``node`` of their ray; ties go to the lower number, rays without nodes to 0.

    Nodes are at most grid / 2 a ray: one array a ray is broadcast."""
    arrays = nodes.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("node", "radius"))).alias("ways"))
    rows = crossings.join(F.broadcast(arrays), "segment", "left")
    near = F.array_min(F.transform("ways", lambda w: F.struct(F.abs(w["radius"] - F.col("distance")).alias("away"), w["node"].alias("node"))))
    return rows.select("transition", "ord", "segment", "distance", F.coalesce(near["node"], F.lit(0)).cast("int").alias("node"))


def edge_events(matched: DataFrame, transitions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``transition``, ``ord``, ``from_segment``, ``from_node``, ``to_segment``, ``to_node``.

    Each crossing is an edge from the node before it, in the order of (transition, ord); a transition without
    crossings is a loop at the last node. Nothing comes before the first crossing, which makes no edge itself.
    ``transitions`` has every position once, in column ``transition``. What is carried from chunk to chunk is
    one row each."""
    every = transitions.select("transition").join(matched.select("transition", "ord", F.struct("segment", "node").alias("to")), "transition", "left")
    every = every.withColumn("chunk", F.floor(F.col("transition") / chunk).cast("long"))
    at = F.struct("transition", "ord")
    lasts = every.groupBy("chunk").agg(F.max_by("to", F.when(F.col("to").isNotNull(), at)).alias("last"))
    before = carried(lasts, F.col("last"), [], name="carried")
    order = Window.partitionBy("chunk").orderBy("transition", "ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = every.withColumn("from", F.last("to", ignorenulls=True).over(order)).join(before, "chunk")
    rows = rows.withColumn("from", F.coalesce("from", "carried")).where("from IS NOT NULL")
    rows = rows.withColumn("to", F.coalesce("to", "from"))
    return rows.select(
        "transition", F.coalesce("ord", F.lit(0)).alias("ord"), F.col("from.segment").alias("from_segment"), F.col("from.node").alias("from_node"),
        F.col("to.segment").alias("to_segment"), F.col("to.node").alias("to_node"),
    )


ENDS = ["from_segment", "from_node", "to_segment", "to_node"]


def edges(events: DataFrame) -> DataFrame:
    """Distinct edges with ``weight``, the number of their events."""
    return events.groupBy(*ENDS).agg(F.count("*").alias("weight"))


def node_degrees(edge_rows: DataFrame) -> DataFrame:
    """``segment``, ``node``, ``degree``: ends of distinct edges; a loop counts twice."""
    ends = F.explode(F.array(F.struct(F.col("from_segment").alias("segment"), F.col("from_node").alias("node")), F.struct(F.col("to_segment").alias("segment"), F.col("to_node").alias("node"))))
    return edge_rows.select(ends.alias("end")).groupBy("end.segment", "end.node").agg(F.count("*").alias("degree"))


def graph_summary(edge_rows: DataFrame) -> DataFrame:
    """One row: distinct nodes and edges, and total weight."""
    nodes = node_degrees(edge_rows).agg(F.count("*").alias("nodes"))
    return edge_rows.agg(F.count("*").alias("edges"), F.sum("weight").alias("total_weight")).join(F.broadcast(nodes))
