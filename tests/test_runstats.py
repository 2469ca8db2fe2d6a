"""The registered statistics of run logs do the whole job."""

from pyspark.sql import functions as F

from raywalk.operators import runstats
from raywalk.plans import queries

SF = "/root/testdata/sf0.001"


def test_every_transfer_is_in_the_curves(spark):
    moved = queries.moves(spark, SF)
    ways = {"sent": ("source", "source != sink"), "received": ("sink", "source != sink"), "looped": ("source", "source = sink")}
    last = queries.transfer_curves(spark, SF).groupBy("processor").agg(*(F.sum(w).alias(w) for w in ways), *(F.max(f"{w}_total").alias(f"{w}_total") for w in ways)).collect()
    for way, (who, where) in ways.items():
        want = {r[0]: r[1] for r in moved.where(where).groupBy(who).agg(F.sum("bytes")).collect()}
        got = {r["processor"]: r[way] for r in last if r[way]}
        assert got == {r["processor"]: r[f"{way}_total"] for r in last if r[f"{way}_total"]}
        # whole bytes a second are counted, so less than one for each second is missing, and the second of a transfer that begins with the run
        assert got.keys() == want.keys() and all(0.995 * want[p] <= got[p] <= want[p] for p in want)


def test_totals_run_over_buckets(spark, monkeypatch):
    rows = [("a", "b", 70, 0, 7_000_000), ("b", "a", 30, 1_500_000, 4_500_000), ("a", "a", 9, 10_500_000, 13_500_000)]
    moved = spark.createDataFrame(rows, "source string, sink string, bytes long, start_us long, end_us long")
    total = runstats.total_time(moved)
    whole = sorted(map(tuple, runstats.transfer_curves(moved, total, 1_000_000).collect()))
    monkeypatch.setattr(runstats, "BINS", 2)
    assert sorted(map(tuple, runstats.transfer_curves(moved, total, 1_000_000).collect())) == whole
    assert [r for r in whole if r[0] == "a"][-1] == ("a", 13.0, 0, 0, 3, 0.0, 0.0, 60, 30, 9)


def test_the_grid_reads_every_measurement(spark):
    run = queries.total(spark, SF.replace("0.001", "0.01")).first()["start_us"]
    rows = queries.machine(spark, SF.replace("0.001", "0.01")).select("processor", (F.col("at_us") - run).alias("t")).orderBy("processor", "t").collect()
    triples = [(a["t"], c["t"]) for a, _, c in zip(rows, rows[1:], rows[2:]) if a["processor"] == c["processor"]]
    assert len(triples) > 9000 and all((c - 1) // queries.STEP > a // queries.STEP for a, c in triples)


def test_step_maxima_are_those_of_the_measurements(spark):
    most = queries.machine(spark, SF).agg(F.max("used_memory")).first()[0]
    found = queries.step_stats(spark, SF).agg(F.max("max_memory")).first()[0]
    assert 0.999 * most <= found <= most
