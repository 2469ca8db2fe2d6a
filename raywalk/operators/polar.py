"""Rays around the origin and their intersections with a trajectory."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raywalk.operators.chunks import CHUNK
from raywalk.operators.windows import lead_pairs


def ray_directions(segments: int) -> list[tuple[int, float, float]]:
    """Ray number and the cosine and sine of its angle; made once, so that all engines use the same doubles."""
    return [(s, math.cos(2 * math.pi * s / segments), math.sin(2 * math.pi * s / segments)) for s in range(segments)]


def ray_table(spark: SparkSession, segments: int) -> DataFrame:
    return spark.createDataFrame(ray_directions(segments), "segment int, ray_cos double, ray_sin double")


def extent(points: DataFrame, scale: float = 1.2) -> DataFrame:
    """One row: ``max_x``, ``max_y`` (of absolute values), ``extent`` and the ray length ``radius``."""
    rows = points.agg(F.max(F.abs("x")).alias("max_x"), F.max(F.abs("y")).alias("max_y"))
    return rows.select("max_x", "max_y", (scale * F.greatest("max_x", "max_y")).alias("extent"), F.sqrt(F.col("max_x") * F.col("max_x") + F.col("max_y") * F.col("max_y")).alias("radius"))


def angle(x: Column, y: Column) -> Column:
    """Polar angle in [0, 2 pi); 0 for NaN."""
    theta = F.atan2(y, x)
    return F.when(F.isnan(theta), 0.0).when(theta < 0, theta + 2 * math.pi).otherwise(theta)


def bucket(theta: Column, segments: int) -> Column:
    return F.floor(theta / (2 * math.pi) * segments).cast("int")


def polar_buckets(points: DataFrame, segments: int) -> DataFrame:
    """Points with ``theta`` and the ray ``bucket`` that they are in."""
    return points.withColumn("theta", angle(F.col("x"), F.col("y"))).withColumn("bucket", bucket(F.col("theta"), segments))


def candidate_rays(points: DataFrame, segments: int, chunk: int = CHUNK) -> DataFrame:
    """``transition``, ``ord`` and ``segment`` of the rays that the step from a point to the next may cross, with both
    points. With ``diff`` the circular distance of their buckets, these are the 2 * (diff + 1) rays from
    bucket - diff - 1 on; at the largest distance some rays come twice."""
    rows = lead_pairs(polar_buckets(points, segments), ["x", "y", "bucket"], chunk)
    direct = F.abs(F.col("bucket") - F.col("next_bucket"))
    diff = F.least(direct, F.lit(segments) - direct)
    rows = rows.withColumn("diff", F.when(diff < 0, 0).otherwise(F.least(diff, F.lit(segments // 2))))
    rows = rows.withColumn("ord", F.explode(F.sequence(F.lit(0), 2 * (F.col("diff") + 1) - 1)))
    return rows.select(F.col("idx").alias("transition"), "ord", F.pmod(F.col("bucket") - F.col("diff") - 1 + F.col("ord"), F.lit(segments)).alias("segment"), "x", "y", "next_x", "next_y")


def intersections(points: DataFrame, segments: int, scale: float = 1.2, chunk: int = CHUNK) -> DataFrame:
    """``transition``, ``ord``, ``segment``, ``distance`` of all crossings. Rays (a row for each) and the extent are broadcast."""
    spark = points.sparkSession
    rows = candidate_rays(points, segments, chunk).join(F.broadcast(ray_table(spark, segments)), "segment").join(F.broadcast(extent(points, scale).select("radius")))
    px, py = F.col("radius") * F.col("ray_cos"), F.col("radius") * F.col("ray_sin")
    rows = rows.select("transition", "ord", "segment", px.alias("px"), py.alias("py"), "x", "y", "next_x", "next_y")
    rows = rows.withColumn("div", (-F.col("px")) * (F.col("y") - F.col("next_y")) - (-F.col("py")) * (F.col("x") - F.col("next_x"))).where("div != 0")
    det = F.col("x") * F.col("next_y") - F.col("next_x") * F.col("y")
    rows = rows.withColumn("cx", F.col("px") * det / F.col("div")).withColumn("cy", F.col("py") * det / F.col("div"))

    def inside(value: str, a: Column, b: Column) -> Column:
        return (F.col(value) >= F.least(a, b)) & (F.col(value) <= F.greatest(a, b))

    zero = F.lit(0.0)
    hit = inside("cx", zero, F.col("px")) & inside("cy", zero, F.col("py")) & inside("cx", F.col("x"), F.col("next_x")) & inside("cy", F.col("y"), F.col("next_y"))
    return rows.where(hit).select("transition", "ord", "segment", F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy")).alias("distance"))
