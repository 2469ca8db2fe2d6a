"""Series in files: headerless big-endian float64, or text with one number a line.

The binary formats are Spark data sources: ``spark.dataSource.register(BinarySeries)``, then
``spark.read.format("raywalk-series").load(path)``. A file is read in byte ranges, one partition each, through
pyarrow.fs, so any store that it knows will do. Filters on ``idx`` narrow the ranges that are read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from raywalk.session import ship

RECORD = 8
#: Records of a read partition, and of an Arrow batch.
SPLIT, BATCH = 8 << 20, 1 << 16


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


class RecordRange(InputPartition):
    def __init__(self, file: str, start: int, end: int, first: int):
        self.file, self.start, self.end, self.first = file, start, end, first


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.low, self.high = int(options.get("start", 0)), None
        if "length" in options:
            self.high = self.low + int(options["length"])

    def partitions(self):
        store, path = store_of(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else sorted((f for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".bin")), key=lambda f: f.path)
        out, first = [], 0
        for f in files:
            n = f.size // RECORD
            a, b = max(self.low - first, 0), n if self.high is None else min(self.high - first, n)
            out += [RecordRange(f.path, i, min(i + self.split, b), first) for i in range(a, max(a, b), self.split)]
            first += n
        return out or [RecordRange("", 0, 0, 0)]

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.end:
            return
        store, _ = store_of(self.path)
        with store.open_input_file(partition.file) as f:
            for i in range(partition.start, partition.end, BATCH):
                j = min(i + BATCH, partition.end)
                values = np.frombuffer(f.read_at((j - i) * RECORD, i * RECORD), ">f8").astype(np.float64)
                idx = np.arange(partition.first + i, partition.first + i + len(values))
                yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(values)], ["idx", "value"])


class NarrowedReader(SeriesReader):
    """A reader that Spark tells its filters, which needs ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters):
        """Narrow the range of positions; every filter is still applied by Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("idx",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            yield f


@dataclass
class Written(WriterCommitMessage):
    file: str
    first: int
    records: int


class SeriesWriter(DataSourceArrowWriter):
    """Writes a file for each task under a hidden name; the commit names the files of the tasks that counted by their first position."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = store_of(self.path)
        store.create_dir(base, recursive=True)
        name = f"{base}/_part-{self.run}-{TaskContext.get().taskAttemptId()}"
        first, last, n = -1, None, 0
        with store.open_output_stream(name) as out:
            for batch in iterator:
                idx = batch.column(batch.schema.names.index("idx")).to_numpy()
                if len(idx):
                    if (np.diff(idx) != 1).any() or (last is not None and idx[0] != last + 1):
                        raise ValueError("a task's positions must be dense and in order: sort by idx before writing")
                    first, last, n = (int(idx[0]) if first < 0 else first), int(idx[-1]), n + len(idx)
                    out.write(batch.column(batch.schema.names.index("value")).to_numpy().astype(">f8").tobytes())
        return Written(name, first, n)

    def commit(self, messages) -> None:
        store, base = store_of(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(base)):
                if f.path.endswith(".bin"):
                    store.delete_file(f.path)
        for k, m in enumerate(sorted((m for m in messages if m is not None), key=lambda m: m.first)):
            if m.records:
                store.move(m.file, f"{base}/{m.first:018d}.bin")
            else:
                store.delete_file(m.file)

    def abort(self, messages) -> None:
        store, _ = store_of(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.file)


class BinarySeries(DataSource):
    """``idx`` and ``value`` of a file, or of a folder's .bin files one after another.

    Options: ``start`` and ``length`` of a part of the series, ``split`` records for each partition, ``pushdown`` (true
    where the session has filter pushdown to Python sources enabled)."""

    @classmethod
    def name(cls) -> str:
        return "raywalk-series"

    def schema(self) -> str:
        return "idx long, value double"

    def reader(self, schema) -> SeriesReader:
        return (NarrowedReader if self.options.get("pushdown") == "true" else SeriesReader)(self.options)

    def writer(self, schema, overwrite: bool) -> SeriesWriter:
        return SeriesWriter(self.options, overwrite)


def read_binary(spark: SparkSession, path: str, start: int = 0, length: int | None = None, split: int = SPLIT) -> DataFrame:
    """A series, or the part of ``length`` records from ``start``, cut at its end. A missing file is an error."""
    ship(spark)
    spark.dataSource.register(BinarySeries)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(BinarySeries.name()).option("start", start).option("split", split).option("pushdown", "true")
    return (reader.option("length", length) if length is not None else reader).load(path)


def write_binary(series: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One file for each range of positions."""
    ship(series.sparkSession)
    series.sparkSession.dataSource.register(BinarySeries)
    ordered = series.select(F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")).orderBy("idx")
    ordered.write.format(BinarySeries.name()).mode(mode).save(path)


def merge_binary(path: str, target: str) -> int:
    """Join a folder's files, in order, into one file outside of Spark; the number of records."""
    store, base = store_of(path)
    out_store, out_path = store_of(target)
    n = 0
    with out_store.open_output_stream(out_path) as out:
        for f in sorted((f for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".bin")), key=lambda f: f.path):
            with store.open_input_stream(f.path) as part:
                while data := part.read(1 << 22):
                    out.write(data)
                    n += len(data) // RECORD
    return n


def empty_series(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "idx long, value double")


def mini_series(spark: SparkSession) -> DataFrame:
    """Four fixed records for tests."""
    return spark.createDataFrame(list(enumerate([4.4, 5.5, 6.6, 7.7])), "idx long, value double")


def indexed(values: DataFrame, value: str = "value", file: str | None = None, block: str | None = None) -> DataFrame:
    """Dense positions in the order of the rows: counts of the partitions before, then places inside. No shuffle of the rows.

    ``file`` and ``block``: columns with a row's file and the start of its split there. Spark deals splits out by size, not
    by name, so rows of files are counted for each split and numbered by names, then starts; numbers in names count by their value."""
    parts = [F.col(file), F.col(block)] if file else [F.lit(""), F.spark_partition_id().cast("long")]
    rows = values.select(F.col(value).alias("value"), *(c.alias(n) for c, n in zip(parts, ("file", "part"))), F.monotonically_increasing_id().alias("id"))
    counts = rows.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("id").alias("low")).collect()  # a row for each split
    before, starts = 0, []
    for r in sorted(counts, key=lambda r: (natural(r["file"]), r["file"], r["part"])):
        starts.append((r["file"], r["part"], before - r["low"]))
        before += r["n"]
    table = F.broadcast(values.sparkSession.createDataFrame(starts or [("", 0, 0)], "file string, part long, shift long"))
    return rows.join(table, ["file", "part"]).select((F.col("id") + F.col("shift")).alias("idx"), "value")


def natural(name: str) -> list:
    """A key that sorts names by the values of the numbers in them: part-99999 before part-100000."""
    return [int(p) if k % 2 else p for k, p in enumerate(re.split(r"([0-9]+)", name))]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A number for each line, in the order of files' names and lines; blank lines are left out. A line that is no number is an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).where(F.trim("value") != "")
    return indexed(lines.select(F.trim("value").cast("double").alias("value"), "file", "block"), file="file", block="block")


def write_text(rows: DataFrame, path: str, value: str = "value", order: str = "idx", single: bool = False, mode: str = "overwrite") -> None:
    """A number for each line in the order of positions; ``single``: in one file, written by one task."""
    rows = rows.orderBy(order)
    (rows.coalesce(1) if single else rows).select(F.col(value).cast("string")).write.mode(mode).text(path)


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def write_null(rows: DataFrame) -> None:
    """Compute everything and keep nothing."""
    rows.write.format("noop").mode("overwrite").save()


def write_csv(rows: DataFrame, path: str, order: str | None = None, mode: str = "overwrite") -> None:
    """Semicolon-separated, with a header and, given an order, a leading column ``index`` from 0. For reports: numbering takes one task."""
    if order:
        kept = [c for c in rows.columns if c != "index"]
        rows = rows.select((F.row_number().over(Window.orderBy(order, *kept)) - 1).alias("index"), *kept).orderBy("index")
    rows.write.mode(mode).option("sep", ";").option("header", True).csv(path)


def expand_size(text: str) -> int:
    """A count such as 250, 10K, 3M or 1B."""
    found = re.fullmatch(r"\s*(\d+)\s*([KMB]?)\s*", text, re.IGNORECASE)
    if not found:
        raise ValueError(f"no count: {text!r}")
    return int(found[1]) * {"": 1, "K": 10**3, "M": 10**6, "B": 10**9}[found[2].upper()]


#: Copies that one row makes at once.
COPIES = 4096


def replicate(series: DataFrame, size: int | str) -> DataFrame:
    """Repeat a series end to end up to ``size`` records, cutting the last repeat. Each record makes its own copies, in two steps of at most
    COPIES and as many tasks as the session shuffles to, so that a short series makes a long one in parallel: no join, no long array."""
    total = expand_size(size) if isinstance(size, str) else size
    n = series.count()
    if not n:
        raise ValueError("an empty series can't be repeated")
    times = -(-total // n)
    blocks = max(1, -(-times // COPIES))
    zero = F.lit(0).cast("long")
    rows = series.select("idx", "value").withColumn("_block", F.explode(F.sequence(zero, F.lit(blocks - 1).cast("long"))))
    if blocks > 1:
        rows = rows.repartition(F.col("_block"), F.col("idx"))
    first = F.col("_block") * COPIES
    rows = rows.withColumn("_time", F.explode(F.sequence(first, F.least(first + (COPIES - 1), F.lit(max(0, times - 1)).cast("long")))))
    return rows.select((F.col("_time") * n + F.col("idx")).alias("idx"), "value").where(F.col("idx") < total)


def first_records(series: DataFrame, n: int) -> DataFrame:
    """The first n records by position, the same ones on every run."""
    return series.where(F.col("idx") < n)


def slices(spark: SparkSession, records: int, workers: int, length: int) -> DataFrame:
    """Even slices of a series with an overlap of length - 1: ``slice``, ``start``, ``end`` (exclusive)."""
    size = -(-records // workers)
    at = F.col("id") * size
    return spark.range(workers).select(F.col("id").alias("slice"), at.alias("start"), F.least(at + size + length - 1, F.lit(records)).alias("end")).where("start < end")


def weighted_slices(spark: SparkSession, records: int, weights: list[float], length: int, master_factor: float = 1.0) -> DataFrame:
    """Slices in proportion to weights, the first of which is scaled down by ``master_factor``, largest first."""
    shares = np.array([w * (master_factor if i == 0 else 1.0) for i, w in enumerate(weights)], float)
    order = np.argsort(-shares, kind="stable")
    cuts = np.ceil(np.cumsum(shares[order] / shares.sum()) * records - 1e-9).astype(np.int64)
    starts = np.concatenate([[0], cuts[:-1]])
    rows = [(int(order[k]), int(s), int(min(e + length - 1, records))) for k, (s, e) in enumerate(zip(starts, cuts)) if s < e]
    return spark.createDataFrame(rows, "slice int, start long, end long")
