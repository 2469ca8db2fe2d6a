"""Scoring new data against a frozen model, as a stream of micro-batches (an addition to the batch pipeline)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raywalk.plans.pipeline import Detector, Model


class _Carry:
    """What a batch leaves to the next one: its rows that aren't scored yet, fewer than a score's reach, and the last node before them. Kept by batch
    number, so that a batch that comes again after a failure finds what it found before."""

    def __init__(self, folder: str | None):
        self.folder, self.held = folder and folder.rstrip("/"), {}

    def read(self, spark: SparkSession, number: int) -> tuple[list[tuple[int, float]], int]:
        if number == 0:
            return [], -1
        if not self.folder:
            return self.held[number - 1]
        rows = spark.read.schema("idx long, value double, before long").parquet(f"{self.folder}/{number - 1}").collect()
        return [(r["idx"], r["value"]) for r in rows if r["idx"] is not None], rows[0]["before"]

    def write(self, spark: SparkSession, number: int, rows: list[tuple[int, float]], before: int) -> None:
        if not self.folder:
            self.held = {n: v for n, v in self.held.items() if n >= number - 1} | {number: (rows, before)}
            return
        held = [(*r, before) for r in rows] or [(None, None, before)]
        spark.createDataFrame(held, "idx long, value double, before long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def score_batches(stream: DataFrame, model: Model, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None, ends: tuple[float, float] | None = None):
    """Start a query on a stream of (idx, value), the next stretch of one series in each micro-batch; a gap or a repeated position is an error.

    Together the batches get the scores that the whole series would get: a score goes out with the batch that brings the last
    record that it depends on, and a batch that completes no score reaches the sink as no rows. ``ends`` are the path
    scores that become 1 and 0, as ``Detector.ends`` gives them; by default each batch is mapped by its own, and batches can't be compared. ``sink`` gets
    (scores, batch number) and should be idempotent by batch number, as a batch may come again after a failure. What batches
    leave to the next one is kept beside ``checkpoint``, in ``<checkpoint>-carry``; without a checkpoint, by the driver."""
    carry = _Carry(checkpoint and f"{checkpoint.rstrip('/')}-carry")
    reach = 2 * model.params.length + model.params.query - 2

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, before = carry.read(spark, number)
        series = batch.select(F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))
        if rows:
            series = series.union(spark.createDataFrame(rows, "idx long, value double"))
        low, high, n = series.agg(F.min("idx"), F.max("idx"), F.count("*")).first()
        if n and high - low != n - 1:
            raise ValueError("positions of a stream must follow each other without a gap")
        left = n - reach  # starts that can be scored
        if left <= 0:
            sink(spark.createDataFrame([], "start_idx long, anomaly_score double"), number)
            carry.write(spark, number, [tuple(r) for r in series.collect()], before)
            return
        detector = Detector(series.select((F.col("idx") - low).alias("idx"), "value"), model.params)
        detector.cross_with(model, before)
        sink(detector.score(model, ends).withColumn("start_idx", F.col("start_idx") + low), number)
        rest = series.where(F.col("idx") >= low + left).orderBy("idx").collect()  # as many as the reach
        carry.write(spark, number, [tuple(r) for r in rest], detector.last_node(model, left, before))

    writer = stream.writeStream.foreachBatch(each)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def windowed_means(stream: DataFrame, time: str, value: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Event-time means and counts by window, with a watermark for late rows: a cheap live view of a raw feed."""
    rows = stream.withWatermark(time, delay).groupBy(F.window(time, width, slide) if slide else F.window(time, width))
    return rows.agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select("window.start", "window.end", "mean", "n")
