"""Position windows without a global sort.

A window over a whole series would bring it into one task. Instead positions fall into chunks, each
chunk also gets the rows of its neighbours that its frames reach into, windows run inside a chunk, and
only a chunk's own rows stay. What must be carried over from arbitrarily far back is carried in two levels:
inside a chunk, then over one row for each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536
#: Chunk rows that are carried over together.
SPAN = 4096


def with_halo(df: DataFrame, chunk: int = CHUNK, after: int = 0, before: int = 0, idx: str = "idx") -> DataFrame:
    """Add ``chunk``; rows within ``after`` positions behind a chunk's end, or ``before`` ahead of its start, are repeated for it."""
    if max(after, before) > chunk:
        raise ValueError("a frame mustn't be longer than a chunk")
    at = F.col(idx)
    own = F.floor(at / chunk).cast("long")
    if not after and not before:
        return df.withColumn("chunk", own)
    least = F.greatest(F.ceil((at + 1 - after) / chunk).cast("long") - 1, F.lit(0).cast("long"))
    most = F.floor((at + before) / chunk).cast("long")
    return df.withColumn("chunk", F.explode(F.sequence(F.least(least, own), most)))


def own_rows(df: DataFrame, chunk: int = CHUNK, idx: str = "idx") -> DataFrame:
    """Drop the repeated rows again."""
    return df.where(F.col("chunk") == F.floor(F.col(idx) / chunk)).drop("chunk")


def frame(first: int, last: int, idx: str = "idx") -> Window:
    return Window.partitionBy("chunk").orderBy(idx).rowsBetween(first, last)


def carried(df: DataFrame, value: Column, order: list[str], chunk: str = "chunk", name: str = "carried") -> DataFrame:
    """``chunk`` and ``name``: the last non-null ``value`` before each chunk, in the order of chunks. A chunk number may be missing."""
    last = df.withColumn("_value", value).groupBy(chunk).agg(F.max_by("_value", F.struct(*order)).alias("last")) if order else df.select(chunk, value.alias("last"))
    last = last.withColumn("span", F.floor(F.col(chunk) / SPAN))
    inside = Window.partitionBy("span").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    local = last.select(chunk, "span", F.last("last", ignorenulls=True).over(inside).alias("local"))
    spans = last.where("last IS NOT NULL").groupBy("span").agg(F.max_by("last", chunk).alias("of_span"))
    # one row for each SPAN chunks
    over = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    every = last.select("span").distinct().join(spans, "span", "left")
    before = every.select("span", F.last("of_span", ignorenulls=True).over(over).alias("from_spans"))
    return local.join(F.broadcast(before), "span").select(chunk, F.coalesce("local", "from_spans").alias(name))
