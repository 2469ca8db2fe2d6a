"""Shared-storage, table and column helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raywalk.session import ship

#: Rows in one Arrow batch sent to Python: a thousand texts of 100 kB make 100 MB.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="raywalk-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: One name for all tables and archives of this process, so that ``clear`` can find them.
_RUN = uuid.uuid4().hex[:12]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{_RUN}-{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> int:
    """Delete all tables and archives that this process has written to the shared folder; their number. Frames that the operators
    returned read from them, so this is for when the results have been written elsewhere."""
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/llm-{_RUN}-*")
    store = found.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [x.getPath() for x in (store.globStatus(found) or [])]
    for path in paths:
        store.delete(path, True)
    return len(paths)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what ``write_table`` wrote; other frames are left alone."""
    path = getattr(df, "shared_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: A key is hot from this many rows on, or from a share of all rows that at most HOT_KEYS keys can have.
HOT_ROWS, HOT_KEYS = 100_000, 1000


def with_value(rows: DataFrame, table: DataFrame, key: str, value: str, total: int, hot_rows: int | None = None) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row for each ``key``: ``value``, never null, and ``rows``, how often the key
    occurs among ``total`` rows). Hot keys, HOT_KEYS of them at most, are looked up in a broadcast and their rows spread evenly over all
    tasks, so that no task gets all rows of one key."""
    hot, salt = free_name(rows, "_hot"), free_name(rows, "_salt")
    often = F.col("rows") >= max(hot_rows or HOT_ROWS, -(-total // HOT_KEYS))
    found = rows.join(F.broadcast(table.where(often).select(key, F.col(value).alias(hot))), key, "left")
    spread = F.when(F.col(hot).isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096)))
    rest = table.where(~often).select(key, value, F.lit(0).cast("long").alias(salt))
    found = found.withColumn(salt, spread).join(rest, [key, salt], "left")
    return found.withColumn(value, F.coalesce(hot, value)).drop(hot, salt)


def bounded_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: ship the package where it is missing, and let Arrow batches
    of whole texts stay small, unless the session asks for smaller ones still. The setting stays for the session, as
    frames run after the call that made them."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, modulus: int):
    """crc32 of a key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
