"""Statistics of run logs: phases, utilisation on an even time grid, transfers, idle and busy time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a bucket inside which neighbouring rows are paired.
BUCKET = 3_600_000_000
IDLE = 0.05
#: Grid times of a bucket inside which running totals are made.
BINS = 4096


def micros(column: str) -> Column:
    return F.unix_micros(column)


def consecutive(rows: DataFrame, key: str, order: list[str], columns: list[str], at: str, bucket: int = BUCKET) -> DataFrame:
    """Rows with ``next``, a struct of the following row's columns (null for the last), and ``is_first``, for each key.

    Windows run inside time buckets; the first row of each bucket is handed to the bucket before, so a
    key with very many rows is not one task. ``at`` is a time in microseconds and leads the order."""
    cells = rows.withColumn("_bucket", F.floor(F.col(at) / bucket).cast("long")).withColumn("_row", F.struct(*columns))
    heads = cells.groupBy(key, "_bucket").agg(F.min_by("_row", F.struct(*order)).alias("_head"))
    over = Window.partitionBy(key).orderBy("_bucket")
    heads = heads.select(key, "_bucket", F.lead("_head").over(over).alias("_after"), F.lag("_bucket").over(over).isNull().alias("_opens"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    cells = cells.withColumn("next", F.lead("_row").over(inside)).withColumn("_place", F.row_number().over(inside))
    cells = cells.join(heads, [key, "_bucket"])
    return cells.select(*rows.columns, F.coalesce("next", "_after").alias("next"), (F.col("_opens") & (F.col("_place") == 1)).alias("is_first"))


def total_time(rows: DataFrame) -> DataFrame:
    """``start_us``, ``end_us`` and ``duration_s`` from the earliest start to the latest end."""
    ends = rows.agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    return ends.withColumn("duration_s", (F.col("end_us") - F.col("start_us")) / 1e6)


def phases(rows: DataFrame, total: DataFrame) -> DataFrame:
    """For each ``name``: start and end in seconds from the run's start, and its absolute and relative duration."""
    run = total.select(F.col("start_us").alias("_zero"), F.col("duration_s").alias("_all"))
    spans = rows.groupBy("name").agg(F.min("start_us").alias("a"), F.max("end_us").alias("b")).join(F.broadcast(run))
    spans = spans.select("name", ((F.col("a") - F.col("_zero")) / 1e6).alias("start_s"), ((F.col("b") - F.col("_zero")) / 1e6).alias("end_s"), ((F.col("b") - F.col("a")) / 1e6).alias("duration_s"), "_all")
    return spans.withColumn("share", F.try_divide(F.col("duration_s"), F.col("_all"))).drop("_all")


def max_memory(machine: DataFrame, order: list[str], column: str = "max_memory") -> DataFrame:
    """A processor's memory as its first measurement gives it."""
    return machine.groupBy("processor").agg(F.min_by(column, F.struct(*order)).alias("max_memory"))


def resampled(machine: DataFrame, zero_us: Column, duration_us: Column, run: DataFrame, step_us: int, order: list[str], swapped: bool = False) -> DataFrame:
    """``processor``, ``k``, ``cpu``, ``memory`` and ``ratio`` at times k * step from the run's start, while these are before its end.

    Between two measurements values are interpolated; before the first and after the last they are constant.
    ``swapped`` gives the nearer measurement the smaller weight, as older reports did. No join: each measurement
    makes the grid points up to the next one."""
    value = ["t", "cpu_ratio", "used_memory", "used_ratio"]
    rows = machine.join(F.broadcast(run)).withColumn("t", F.col("at_us") - zero_us).withColumn("_last", F.floor((duration_us - 1) / step_us).cast("long"))
    pairs = consecutive(rows, "processor", order, value, "at_us")
    start = F.when(F.col("is_first"), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.ceil(F.col("t") / step_us).cast("long")))
    end = F.when(F.col("next").isNull(), F.col("_last")).otherwise(F.least(F.col("_last"), F.ceil(F.col("next.t") / step_us).cast("long") - 1))
    pairs = pairs.withColumn("_a", start).withColumn("_b", end).where("_b >= _a")
    pairs = pairs.withColumn("k", F.explode(F.sequence("_a", "_b")))
    far = (F.col("k") * step_us - F.col("t")) / (F.col("next.t") - F.col("t"))
    flat = F.col("next").isNull() | (F.col("k") * step_us < F.col("t")) | (F.col("next.t") == F.col("t"))
    weight = F.when(flat, 1.0).otherwise(far if swapped else 1 - far)

    def at(name: str) -> Column:
        return F.when(flat, F.col(name).cast("double")).otherwise(F.col(name) * weight + F.col(f"next.{name}") * (1 - weight))

    return pairs.select("processor", "k", at("cpu_ratio").alias("cpu"), F.floor(at("used_memory")).cast("long").alias("memory"), at("used_ratio").alias("ratio"))


def cluster_utilisation(samples: DataFrame, memory: DataFrame, step_us: int) -> DataFrame:
    """For each grid time: mean, least and greatest processor load, and total, mean, least and greatest memory, absolute and relative.

    Loads are added up as decimals of 18 places, so that the mean doesn't depend on the order of rows."""
    total = memory.agg(F.sum("max_memory").alias("_total"), F.count("*").alias("_n"))
    rows = samples.groupBy("k").agg(
        F.avg(F.col("cpu").cast("decimal(28, 18)")).cast("double").alias("avg_cpu"), F.min("cpu").alias("min_cpu"), F.max("cpu").alias("max_cpu"), F.sum("memory").alias("total_memory"),
        F.avg("memory").alias("avg_memory"), F.min("memory").alias("min_memory"), F.max("memory").alias("max_memory"),
        F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"),
    )
    rows = rows.join(F.broadcast(total))
    return rows.select(
        (F.col("k") * step_us / 1e6).alias("time_s"), "avg_cpu", "min_cpu", "max_cpu", "total_memory", (F.col("total_memory") / F.col("_total")).alias("total_ratio"),
        "avg_memory", (F.col("avg_memory") / (F.col("_total") / F.col("_n"))).alias("avg_ratio"), "min_memory", "min_ratio", "max_memory", "max_ratio",
    )


def transfer_stats(transfers: DataFrame, total: DataFrame) -> DataFrame:
    """For each ``name``: span, received volume without loopback, mean rate, the largest and smallest volume of one
    processor, the number of processors that took part, and the share of all volume. Names that moved nothing are left out."""
    run = total.select(F.col("start_us").alias("_zero"), F.col("duration_s").alias("_run"))
    spans = transfers.groupBy("name").agg(F.min("start_us").alias("a"), F.max("end_us").alias("b"))
    moved = transfers.where("source != sink")
    ends = moved.withColumn("who", F.explode(F.array("source", "sink")))
    each = ends.groupBy("name", "who").agg(F.sum(F.when((F.col("sink") == F.col("who")) & (F.col("processor") == F.col("who")), F.col("bytes")).otherwise(0)).alias("received"))
    names = each.groupBy("name").agg(F.sum("received").alias("volume"), F.max("received").alias("max_volume"), F.min("received").alias("min_volume"), F.count("*").alias("processors")).where("volume > 0")
    rows = names.join(spans, "name").join(F.broadcast(run)).join(F.broadcast(names.agg(F.sum("volume").alias("_everything"))))
    duration = (F.col("b") - F.col("a")) / 1e6
    return rows.select(
        "name", ((F.col("a") - F.col("_zero")) / 1e6).alias("start_s"), ((F.col("b") - F.col("_zero")) / 1e6).alias("end_s"), duration.alias("duration_s"),
        F.try_divide(duration, F.col("_run")).alias("duration_share"), "volume", (F.col("volume") / F.col("_everything")).alias("volume_share"),
        F.try_divide(F.col("volume"), duration).alias("rate"), "max_volume", (F.col("max_volume") / F.col("volume")).alias("max_share"),
        "min_volume", (F.col("min_volume") / F.col("volume")).alias("min_share"), "processors",
    )


def processor_phases(machine: DataFrame, phase_rows: DataFrame, run: DataFrame, order: list[str]) -> DataFrame:
    """For each phase and processor: idle and busy seconds of the measurement pairs that begin in the phase, and the most
    memory. A pair is idle if the load is under 5 % at both ends. Phases, a row for each kind of event, are broadcast."""
    rows = machine.join(F.broadcast(run.select(F.col("start_us").alias("_zero")))).withColumn("t", (F.col("at_us") - F.col("_zero")) / 1e6)
    pairs = consecutive(rows, "processor", order, ["t", "cpu_ratio"], "at_us").where("next IS NOT NULL")
    pairs = pairs.withColumn("length", F.col("next.t") - F.col("t")).withColumn("idle", (F.col("cpu_ratio") < IDLE) & (F.col("next.cpu_ratio") < IDLE))
    kinds = phase_rows.select("name", "start_s", "end_s", "duration_s")
    inside = pairs.join(F.broadcast(kinds), (F.col("t") >= F.col("start_s")) & (F.col("t") <= F.col("end_s")))
    rows = inside.groupBy("name", "processor", "duration_s").agg(
        F.sum(F.when(F.col("idle"), F.col("length")).otherwise(0.0)).alias("idle_s"), F.sum(F.when(~F.col("idle"), F.col("length")).otherwise(0.0)).alias("busy_s"),
        F.max("used_memory").alias("max_memory"), F.max("used_ratio").alias("max_ratio"),
    )
    return rows.select("name", "processor", "idle_s", F.try_divide("idle_s", "duration_s").alias("idle_share"), "busy_s", F.try_divide("busy_s", "duration_s").alias("busy_share"), "max_memory", "max_ratio")


def phase_stats(phase_rows: DataFrame, utilisation: DataFrame, processors: DataFrame, count: DataFrame) -> DataFrame:
    """For each phase: mean utilisation and largest memory on the grid, and idle and busy time over all processors. ``count``: one row, column ``n``."""
    grid = utilisation.join(F.broadcast(phase_rows.select("name", "start_s", "end_s")), (F.col("time_s") >= F.col("start_s")) & (F.col("time_s") <= F.col("end_s")))
    grid = grid.groupBy("name").agg(F.avg("avg_cpu").alias("avg_cpu"), F.avg("avg_memory").alias("avg_memory"), F.avg("avg_ratio").alias("avg_ratio"), F.max("max_memory").alias("max_memory"), F.max("max_ratio").alias("max_ratio"))
    times = processors.groupBy("name").agg(F.sum("idle_s").alias("idle_s"), F.max("idle_s").alias("max_idle_s"), F.sum("busy_s").alias("busy_s"), F.max("busy_s").alias("max_busy_s"))
    rows = phase_rows.join(grid, "name", "left").join(times, "name", "left").join(F.broadcast(count))
    whole = F.col("duration_s") * F.col("n")
    return rows.select(
        "name", "duration_s", whole.alias("summed_s"), "avg_cpu", "avg_memory", "avg_ratio", "max_memory", "max_ratio",
        "idle_s", F.try_divide(F.col("idle_s"), whole).alias("idle_share"), (F.col("idle_s") / F.col("n")).alias("avg_idle_s"), "max_idle_s", F.try_divide("max_idle_s", "duration_s").alias("max_idle_share"),
        "busy_s", F.try_divide(F.col("busy_s"), whole).alias("busy_share"), (F.col("busy_s") / F.col("n")).alias("avg_busy_s"), "max_busy_s", F.try_divide("max_busy_s", "duration_s").alias("max_busy_share"),
    )


def transfer_curves(transfers: DataFrame, total: DataFrame, step_us: int) -> DataFrame:
    """For each processor and each grid time from 0 to before the run's end: bytes in the step, sent, received and looped back, the
    rates of sending and receiving in MiB a second, and running totals; times without traffic have zeros. A transfer counts at the
    grid times strictly inside it, each with its rate times the step, cut to whole bytes: a step longer than a transfer can miss it.
    Totals run, and gaps are filled, inside buckets of grid times, so a long run is not one task."""
    run = total.select(F.col("start_us").alias("_zero"), F.col("end_us").alias("_end"), F.greatest(F.lit(0).cast("long"), F.ceil((F.col("end_us") - F.col("start_us")) / step_us).cast("long") - 1).alias("_final"))
    rows = transfers.join(F.broadcast(run))
    rows = rows.withColumn("a", F.col("start_us") - F.col("_zero")).withColumn("b", F.least(F.col("end_us") - F.col("_zero"), F.col("_end") - F.col("_zero")))
    rows = rows.withColumn("_first", F.greatest(F.lit(1).cast("long"), F.floor(F.col("a") / step_us).cast("long") + 1)).withColumn("_last", F.ceil(F.col("b") / step_us).cast("long") - 1).where("_last >= _first")
    part = F.floor(F.col("bytes") * F.lit(float(step_us)) / (F.col("end_us") - F.col("start_us"))).cast("long")
    rows = rows.withColumn("part", part).withColumn("k", F.explode(F.sequence("_first", "_last")))
    who = F.when(F.col("source") == F.col("sink"), F.array(F.struct(F.col("source").alias("p"), F.lit("loop").alias("way")))).otherwise(F.array(F.struct(F.col("source").alias("p"), F.lit("sent").alias("way")), F.struct(F.col("sink").alias("p"), F.lit("received").alias("way"))))
    rows = rows.select("k", "part", F.inline(who)).withColumn("_bucket", F.floor(F.col("k") / BINS).cast("long"))
    ways = ["sent", "received", "looped"]
    # a row without traffic opens each bucket
    opens = transfers.select(F.explode(F.array("source", "sink")).alias("p")).distinct().join(F.broadcast(run)).select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_final") / BINS).cast("long"))).alias("_bucket"))
    opens = opens.select((F.col("_bucket") * BINS).alias("k"), F.lit(0).cast("long").alias("part"), "p", F.lit("sent").alias("way"), "_bucket")
    sums = [F.sum(F.when(F.col("way") == w, F.col("part")).otherwise(0)).alias(n) for w, n in zip(("sent", "received", "loop"), ways)]
    bins = rows.union(opens).groupBy("p", "_bucket", "k").agg(*sums)
    earlier = Window.partitionBy("p").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = bins.groupBy("p", "_bucket").agg(*(F.sum(c).alias(c) for c in ways))
    before = before.select("p", "_bucket", *(F.coalesce(F.sum(c).over(earlier), F.lit(0).cast("long")).alias(f"_{c}") for c in ways))
    order = Window.partitionBy("p", "_bucket").orderBy("k")
    inside = order.rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumns({f"{c}_total": F.sum(c).over(inside) for c in ways} | {"_next": F.lead("k").over(order)}).join(before, ["p", "_bucket"]).join(F.broadcast(run.select("_final")))
    until = F.coalesce(F.col("_next") - 1, F.least((F.col("_bucket") + 1) * BINS - 1, "_final"))
    bins = bins.withColumn("at", F.explode(F.sequence("k", until)))
    bins = bins.withColumns({c: F.when(F.col("at") == F.col("k"), F.col(c)).otherwise(F.lit(0).cast("long")) for c in ways})
    return bins.select(F.col("p").alias("processor"), (F.col("at") * step_us / 1e6).alias("time_s"), *ways, *((F.col(c) / (step_us / 1e6 * 1024**2)).alias(f"{c}_mib_s") for c in ways[:2]), *((F.col(f"{c}_total") + F.col(f"_{c}")).alias(f"{c}_total") for c in ways))


#: Parts of the memory in use, where the measurements have them.
PARTS = ("heap", "stack")


def machine_series(machine: DataFrame, run: DataFrame) -> DataFrame:
    """Load, memory and the shares of heap and stack of each processor by seconds from the run's start."""
    rows = machine.join(F.broadcast(run.select(F.col("start_us").alias("_zero"))))
    parts = [(F.col(c) / F.col("max_memory")).alias(f"{c}_ratio") for c in PARTS if c in machine.columns]
    return rows.select("processor", ((F.col("at_us") - F.col("_zero")) / 1e6).alias("time_s"), "cpu_ratio", "used_memory", "used_ratio", *parts)


def machine_peaks(machine: DataFrame, run: DataFrame, order: list[str]) -> DataFrame:
    """For each processor: the greatest load, memory and shares of heap and stack, and the earliest times at which they were measured."""
    rows = machine.join(F.broadcast(run.select(F.col("start_us").alias("_zero")))).withColumn("time_s", (F.col("at_us") - F.col("_zero")) / 1e6)
    rows = rows.withColumns({f"{c}_ratio": F.col(c) / F.col("max_memory") for c in PARTS if c in machine.columns})
    first = [-F.unix_micros(o) if o == "date_time" else -F.col(o) for o in order]
    names = {"cpu": "cpu_ratio", "used": "used_memory"} | {c: f"{c}_ratio" for c in PARTS if c in machine.columns}
    tops = [(F.max(c).alias(f"max_{n}"), F.max_by("time_s", F.struct(c, *first)).alias(f"max_{n}_at_s")) for n, c in names.items()]
    return rows.groupBy("processor").agg(*(x for pair in tops for x in pair))


def exchange_series(queues: DataFrame) -> DataFrame:
    """Message queues of each processor with each other one, by microseconds from the pair's first measurement (``at_us``)."""
    first = queues.groupBy("processor", "remote").agg(F.min("at_us").alias("_zero"))
    rows = queues.join(F.broadcast(first), ["processor", "remote"])  # a row for each pair of processors
    return rows.select("processor", "remote", (F.col("at_us") - F.col("_zero")).alias("time_us"), "enqueued", "unacknowledged", "largest_queue", "largest_receiver", "average_enqueued")


def pool_series(pools: DataFrame) -> DataFrame:
    """Workers of each processor's pool, the busy share and the queue, by microseconds from its first measurement (``at_us``)."""
    rows = pools.join(F.broadcast(pools.groupBy("processor").agg(F.min("at_us").alias("_zero"))), "processor")
    return rows.select("processor", (F.col("at_us") - F.col("_zero")).alias("time_us"), "workers", "available", "workers_ratio", "queue")
