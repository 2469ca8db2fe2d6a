"""Run logs: lines ``[yyyy/MM/dd HH:mm:ss.SSS]  -  Event { Key = Value; ... }``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The body ends before the last brace, less one space; found from the line's end, as a lazy match would try each place.
LINE = r"^\[(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\]\s+-\s+(\w+) \{ (.*(?= \}\s*$)|.*(?=\}\s*$)) ?\}\s*$"
TIME = "yyyy/MM/dd HH:mm:ss.SSS"
#: Names of the events in a run log.
DURATIONS = [
    "DataTransferred", "ProjectionCreated", "PCACreated", "DimensionReductionCreated", "IntersectionsCreated", "NodesExtracted",
    "EdgePartitionCreated", "PathScoresCreated", "PathScoresNormalized", "CalculationCompleted", "ResultsPersisted",
]
MEASUREMENTS = ["MachineUtilization", "MessageExchangeUtilization", "ActorPoolUtilization", "ActorSystemUtilization"]


def properties(text: Column) -> Column:
    """``k = v; k = v;`` as a map; of a repeated key the last value holds.

    Each step is bound to a lambda's variable: an expression that is named twice is worked out twice."""
    pairs = F.filter(F.transform(F.split(text, r";\s*"), lambda p: F.split(p, r"\s=\s", 2)), lambda p: F.size(p) == 2)
    pairs = F.transform(pairs, lambda p: F.struct(F.trim(F.get(p, F.lit(0))).alias("key"), F.trim(F.get(p, F.lit(1))).alias("value")))
    keys = lambda p: F.array_distinct(p["key"])
    last = lambda p: F.transform(keys(p), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(p, lambda q: q["key"] == k), -1)["value"].alias("value")))
    return F.map_from_entries(F.get(F.transform(F.array(pairs), lambda p: F.when(F.size(keys(p)) == F.size(p), p).otherwise(last(p))), F.lit(0)))


def parse_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """``ts``, ``event``, ``props``; other columns pass through. Lines of another form are skipped."""
    rest = [c for c in lines.columns if c != value]
    rows = lines.where(F.col(value).rlike(LINE))
    return rows.select(*rest, F.to_timestamp(F.regexp_extract(value, LINE, 1), TIME).alias("ts"), F.regexp_extract(value, LINE, 2).alias("event"), properties(F.regexp_extract(value, LINE, 3)).alias("props"))


def malformed(lines: DataFrame, value: str = "value") -> int:
    """Number of lines that are no events."""
    return lines.where(~F.col(value).rlike(LINE) & (F.trim(value) != "")).count()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def stamp(props: str, key: str) -> Column:
    return F.to_timestamp(F.col(props)[key], TIME)


def durations(events: DataFrame) -> DataFrame:
    """``event``, ``processor``, ``start_time``, ``end_time``, ``duration_s`` of the duration events."""
    rows = events.where(F.col("event").isin(DURATIONS))
    rows = rows.select("event", F.col("props")["Processor"].alias("processor"), stamp("props", "StartTime").alias("start_time"), stamp("props", "EndTime").alias("end_time"), "props")
    return rows.withColumn("duration_s", seconds_between("start_time", "end_time"))


def seconds_between(a: str, b: str) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def simplified(kind: Column) -> Column:
    """``x.M$InitializeNodesTransferMessage`` -> ``Nodes``."""
    name = F.coalesce(F.get(F.split(kind, r"\$"), F.lit(1)), kind)
    return F.regexp_replace(F.regexp_replace(name, "^Initialize", ""), "TransferMessage$", "")


def transfers(events: DataFrame) -> DataFrame:
    """``name``, ``processor``, ``source``, ``sink``, ``bytes``, ``start_time``, ``end_time`` of the data transfers."""
    rows = durations(events).where("event = 'DataTransferred'")
    p = F.col("props")
    return rows.select(simplified(p["Type"]).alias("name"), "processor", p["Source"].alias("source"), p["Sink"].alias("sink"), p["Bytes"].cast("long").alias("bytes"), "start_time", "end_time")


def machine(events: DataFrame) -> DataFrame:
    """``processor``, ``date_time``, ``max_memory``, ``heap``, ``stack``, ``used_memory`` (both), ``used_ratio``, ``cpu_ratio``."""
    p = F.col("props")
    rows = events.where("event = 'MachineUtilization'").select(
        p["Processor"].alias("processor"), stamp("props", "DateTime").alias("date_time"), p["MaximumMemory"].cast("long").alias("max_memory"),
        p["UsedHeap"].cast("long").alias("heap"), p["UsedStack"].cast("long").alias("stack"), (p["UsedHeap"].cast("long") + p["UsedStack"].cast("long")).alias("used_memory"), p["CPULoad"].cast("double").alias("cpu_ratio"),
    )
    return rows.withColumn("used_ratio", F.col("used_memory") / F.col("max_memory"))


def pools(events: DataFrame) -> DataFrame:
    """``processor``, ``date_time``, ``workers``, ``available``, ``workers_ratio`` (busy share), ``queue``."""
    p = F.col("props")
    rows = events.where("event = 'ActorPoolUtilization'").select(p["Processor"].alias("processor"), stamp("props", "DateTime").alias("date_time"), p["Workers"].cast("long").alias("workers"), p["AvailableWorkers"].cast("long").alias("available"), p["QueueSize"].cast("long").alias("queue"))
    return rows.withColumn("workers_ratio", F.try_divide(F.col("workers") - F.col("available"), F.col("workers")))


def message_queues(events: DataFrame) -> DataFrame:
    """Queue sizes of the message exchange."""
    p = F.col("props")
    return events.where("event = 'MessageExchangeUtilization'").select(
        p["Processor"].alias("processor"), stamp("props", "DateTime").alias("date_time"), p["RemoteProcessor"].alias("remote"),
        p["TotalNumberOfEnqueuedMessages"].cast("long").alias("enqueued"), p["TotalNumberOfUnacknowledgedMessages"].cast("long").alias("unacknowledged"),
        p["LargestMessageQueueSize"].cast("long").alias("largest_queue"), p["LargestMessageQueueReceiver"].alias("largest_receiver"),
        p["AverageNumberOfEnqueuedMessages"].cast("double").alias("average_enqueued"),
    )


def write_log(events: DataFrame, path: str) -> None:
    """Append events (ts, event, props) as lines."""
    body = F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit(" = "), e["value"], F.lit("; "))), "")
    line = F.concat(F.lit("["), F.date_format("ts", TIME), F.lit("]  -  "), F.col("event"), F.lit(" { "), body, F.lit("}"))
    events.orderBy("ts").select(line).write.mode("append").text(path)
