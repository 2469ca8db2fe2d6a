"""Connected components by alternating large-star and small-star steps.

Each step is one aggregate (the least neighbour of every node) and one join back; a hot node is
handled by partial aggregation and by spreading its rows in the join. After each pair of steps the lineage is cut by
a table in the shared folder; it ends when every edge leads from a node of its own to a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raywalk.llm import shared

ROWS_OF_A_FILE = 500_000


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Edges with ``m`` of their u; the neighbours of a hub are spread over all tasks."""
    return shared.with_value(edges, least, "u", "m", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("rows"))
    return _with_least(both, least, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them. An edge points from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
    moved = _with_least(edges, least, total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether no node has two edges or is both a root and a leaf."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the least node that it reaches, for every node with an edge to another.

    Null ends and self links are ignored; the directions and repeats of links don't matter.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} != {b}").distinct()
    edges = shared.write_table(edges, "cc")
    while not _is_forest(edges):
        total = edges.count()
        new = shared.write_table(_small_star(_large_star(edges, total), total).coalesce(1 + total // ROWS_OF_A_FILE), "cc")
        shared.drop_table(edges)
        edges = new
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
