"""Densities of crossing distances along each ray, and their local maxima: the nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raywalk.operators.numeric import density_sums
from raywalk.session import ship


def segment_stats(crossings: DataFrame) -> DataFrame:
    """``segment``, ``k`` samples, unbiased ``variance`` and ``whitening`` 1 / (sigma * k**(-1/5)); null variance for one sample."""
    rows = crossings.groupBy("segment").agg(F.count("*").alias("k"), F.var_samp("distance").alias("variance"))
    return rows.withColumn("whitening", F.when(F.col("variance") > 0, F.pow("k", F.lit(0.2)) / F.sqrt("variance")))


def _samples(crossings: DataFrame, extent: DataFrame) -> DataFrame:
    """Crossings of the rays that have a density, each with its ray's numbers. Statistics have a row for each ray, the extent is one row."""
    stats = F.broadcast(segment_stats(crossings).where("whitening IS NOT NULL"))
    return crossings.join(stats, "segment").join(F.broadcast(extent.select("extent"))).select("segment", "k", "extent", "whitening", "distance")


def _finished(sums: DataFrame, grid: int) -> DataFrame:
    return sums.select("segment", "u", (F.col("u") * F.col("extent") / grid).alias("radius"), (F.col("total") / F.col("k")).alias("density"))


def density_grid(crossings: DataFrame, extent: DataFrame, grid: int = 250) -> DataFrame:
    """``segment``, ``u``, ``radius`` and ``density`` at the points u * extent / grid of each ray that has a density.

    Each task adds up all its crossings of a ray at all grid points with numpy, so only ``grid`` numbers for each ray and task are
    shuffled, and a ray with most of the crossings is no bottleneck."""
    ship(crossings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            segment, k, extents, whitening, distance = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.argsort(segment, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(segment[order])) + 1):
                if len(own):
                    i = own[0]
                    entry = found.setdefault(int(segment[i]), [int(k[i]), float(extents[i]), np.zeros(grid)])
                    entry[2] += density_sums(distance[own], np.arange(grid) * entry[1] / grid, whitening[i])
        for s, (n, e, total) in found.items():
            yield pa.RecordBatch.from_pydict({"segment": np.full(grid, s, np.int32), "u": np.arange(grid, dtype=np.int32), "k": np.full(grid, n), "extent": np.full(grid, e), "total": total})

    rows = _samples(crossings, extent).mapInArrow(run, "segment int, u int, k long, extent double, total double")
    return _finished(rows.groupBy("segment", "u").agg(F.first("k").alias("k"), F.first("extent").alias("extent"), F.sum("total").alias("total")), grid)


def density_grid_relational(crossings: DataFrame, extent: DataFrame, grid: int = 250) -> DataFrame:
    """The same by built-in functions alone: a row for each crossing and grid point, added up with partial aggregation. A check of the other, for small data."""
    points = _samples(crossings, extent).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    away = (F.col("distance") - F.col("u") * F.col("extent") / grid) * F.col("whitening")
    return _finished(points.groupBy("segment", "u").agg(F.first("k").alias("k"), F.first("extent").alias("extent"), F.sum(F.exp(-0.5 * away * away)).alias("total")), grid)


def local_maxima(density: DataFrame) -> DataFrame:
    """Grid points that are higher than both neighbours, ends left out, numbered from 0 along each ray."""
    order = Window.partitionBy("segment").orderBy("u")
    rows = density.select("*", F.lag("density").over(order).alias("_before"), F.lead("density").over(order).alias("_after"))
    rows = rows.where((F.col("density") > F.col("_before")) & (F.col("density") > F.col("_after")))
    return rows.select("segment", (F.row_number().over(order) - 1).alias("node"), "radius")


def extract_nodes(crossings: DataFrame, extent: DataFrame, grid: int = 250) -> DataFrame:
    """``segment``, ``node``, ``radius``."""
    return local_maxima(density_grid(crossings, extent, grid))
