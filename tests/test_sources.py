"""Files: round trips, ranges, order, logs."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from raywalk import cli
from raywalk.sources import dumps, runlog, series

LOG = """[2020/05/01 10:00:00.050]  -  MachineUtilization { Processor = A; DateTime = 2020/05/01 10:00:00.000; MaximumMemory = 1000; UsedHeap = 300; UsedStack = 50; CPULoad = 0.25; }
[2020/05/01 10:00:00.150]  -  MachineUtilization { Processor = A; DateTime = 2020/05/01 10:00:00.100; MaximumMemory = 1000; UsedHeap = 400; UsedStack = 50; CPULoad = 0.01; }
[2020/05/01 10:00:01.000]  -  PCACreated { Processor = A; StartTime = 2020/05/01 10:00:00.100; EndTime = 2020/05/01 10:00:00.900; Duration = PT0.8S; }
[2020/05/01 10:00:01.200]  -  DataTransferred { Processor = B; StartTime = 2020/05/01 10:00:01.000; EndTime = 2020/05/01 10:00:01.100; Duration = PT0.1S; Type = x.M$InitializeNodesTransferMessage; Source = A; Sink = B; Duration = PT0.2S; Bytes = 800; }
[2020/05/01 10:00:01.300]  -  CalculationCompleted { Processor = A; StartTime = 2020/05/01 10:00:00.000; EndTime = 2020/05/01 10:00:01.300; Duration = PT1.3S; }
not a log line
"""


def test_binary_round_trip_in_ranges(spark, tmp_path):
    v = np.random.default_rng(3).normal(size=1000)
    path = str(tmp_path / "one.bin")
    (tmp_path / "one.bin").write_bytes(struct.pack("!1000d", *v))
    df = series.read_binary(spark, path, split=130)
    assert df.rdd.getNumPartitions() == 8
    assert [r["value"] for r in df.orderBy("idx").collect()] == v.tolist()
    part = series.read_binary(spark, path, start=100, length=5000)
    assert part.agg(F.min("idx"), F.max("idx"), F.count("*")).first() == (100, 999, 900)
    out = str(tmp_path / "many")
    series.write_binary(df, out)
    assert [r["value"] for r in series.read_binary(spark, out).orderBy("idx").collect()] == v.tolist()
    assert series.merge_binary(out, str(tmp_path / "joined.bin")) == 1000
    assert (tmp_path / "joined.bin").read_bytes() == (tmp_path / "one.bin").read_bytes()
    assert [r["value"] for r in series.read_binary(spark, out).where("idx >= 990 AND idx < 993").orderBy("idx").collect()] == v[990:993].tolist()
    with pytest.raises(Exception):
        series.read_binary(spark, str(tmp_path / "missing.bin")).count()


def test_text_keeps_the_order_of_lines(spark, tmp_path):
    (tmp_path / "in.txt").write_text("0.333443\n0.466437\n\n-1e3\n")
    df = series.read_text(spark, str(tmp_path / "in.txt"))
    assert [tuple(r) for r in df.orderBy("idx").collect()] == [(0, 0.333443), (1, 0.466437), (2, -1000.0)]
    assert series.line_count(spark, str(tmp_path / "in.txt")) == 4
    series.write_text(df, str(tmp_path / "out"), single=True)
    assert [float(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().split()] == [0.333443, 0.466437, -1000.0]
    big = series.indexed(spark.range(10_000, numPartitions=7).select(F.col("id").cast("double").alias("value")))
    assert big.where("idx != value").count() == 0 and big.count() == 10_000


def test_text_of_several_files_keeps_the_order_of_names_and_lines(spark, tmp_path):
    sizes, n = {9: 3, 10: 1, 11: 400, 12: 20, 99999: 2, 100000: 50}, 0
    for part, size in sizes.items():
        (tmp_path / f"part-{part:05d}-x.txt").write_text("".join(f"{float(i)}\n" for i in range(n, n + size)))
        n += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200b", before):  # files in several splits, and several files in one partition
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = series.read_text(spark, str(tmp_path))
            assert df.where("idx != value").count() == 0 and sorted(r["idx"] for r in df.collect()) == list(range(n))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_replicate_and_sizes(spark):
    assert [series.expand_size(x) for x in ("12", "3k", "2M", "1B")] == [12, 3000, 2_000_000, 10**9]
    with pytest.raises(ValueError):
        series.expand_size("1.5K")
    got = [r["value"] for r in series.replicate(series.mini_series(spark), 10).orderBy("idx").collect()]
    assert got == [4.4, 5.5, 6.6, 7.7, 4.4, 5.5, 6.6, 7.7, 4.4, 5.5]
    assert series.replicate(series.mini_series(spark), 2).count() == 2
    with pytest.raises(ValueError):
        series.replicate(series.empty_series(spark), 5)


def test_slices_cover_and_overlap(spark):
    rows = series.slices(spark, 1000, 3, 50).orderBy("slice").collect()
    assert [(r["start"], r["end"]) for r in rows] == [(0, 383), (334, 717), (668, 1000)]
    rows = series.weighted_slices(spark, 1000, [1.0, 3.0, 1.0], 50, 1.0).collect()
    assert rows[0]["slice"] == 1 and rows[-1]["end"] == 1000


def test_dumps_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 0, 1.25), (3, 1, 0.5)], "segment int, node int, radius double")
    dumps.write_nodes(nodes, str(tmp_path / "nodes"))
    assert sorted(map(tuple, dumps.read_nodes(spark, str(tmp_path / "nodes")).collect())) == [(0, 0, 1.25), (3, 1, 0.5)]
    m = np.array([[1.0, 2.5], [3.0, -4.0], [0.1, 1e-9]])
    assert (dumps.parse_matrix(dumps.format_matrix(m)) == m).all() and (dumps.unpack_matrix(dumps.pack_matrix(m)) == m).all()
    (tmp_path / "m.bin").write_bytes(dumps.pack_matrix(m))
    assert dumps.read_matrix(spark, str(tmp_path / "m.bin")).count() == 6
    with pytest.raises(ValueError):
        dumps.unpack_matrix(b"\0" * 16 + b"x")


def test_log_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    lines = spark.read.text(str(tmp_path / "a.log"))
    assert runlog.malformed(lines) == 1
    events = runlog.parse_log(lines)
    assert events.count() == 5
    move = runlog.transfers(events).first()
    assert (move["name"], move["source"], move["sink"], move["bytes"]) == ("Nodes", "A", "B", 800)
    assert events.where("event = 'DataTransferred'").first()["props"]["Duration"] == "PT0.2S"
    assert runlog.durations(events).where("event = 'PCACreated'").first()["duration_s"] == pytest.approx(0.8)
    assert [tuple(r) for r in runlog.machine(events).select("used_memory", "used_ratio").orderBy("used_memory").collect()] == [(350, 0.35), (450, 0.45)]


def test_command_line(spark, tmp_path):
    (tmp_path / "in.txt").write_text("\n".join(str(x) for x in np.random.default_rng(0).normal(size=400).round(4)) + "\n")
    (tmp_path / "run.log").write_text(LOG)
    args = lambda *a: cli.main([str(x) for x in a])
    assert args("convert", "--input", tmp_path / "in.txt", "--output", tmp_path / "bin") == 0
    assert args("detect", "--input", tmp_path / "bin", "--output", tmp_path / "scores", "--single-file") == 0
    assert len("".join(p.read_text() for p in (tmp_path / "scores").glob("part-*")).split()) == pytest.approx(400 - 100 - 75 + 2, abs=3)
    assert args("report", "--input", tmp_path / "run.log", "--output", tmp_path / "report") == 0
    text = "".join(p.read_text() for p in (tmp_path / "report" / "transfers").glob("part-*"))
    assert "Nodes" in text and ";" in text


def test_line_pattern_takes_the_same_parts_as_a_lazy_one(spark):
    lazy = r"^\[(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\]\s+-\s+(\w+) \{ (.*?) ?\}\s*$"
    bodies = ["{ }", "{  }", "{   }", "{ a = 1; }", "{ a = 1; } ", "{ a = 1;  }\t ", "{ a = }", "{ a =  }", "{ a = } }", "{ a = }}", "{ a = {x}; b = 2}", "{}", "{ a = 1;", "{ a = 1; } x", "a = 1 }", "{ a = 1; }\r", "{ a = 1; \u2028}"]
    lines = spark.createDataFrame([(f"[2020/05/01 10:00:00.050]  -  Event {b}",) for b in bodies], "value string")
    parts = lambda pattern: F.when(F.col("value").rlike(pattern), F.array(*(F.regexp_extract("value", pattern, k) for k in (1, 2, 3))))
    got = lines.select(parts(runlog.LINE).alias("new"), parts(lazy).alias("old")).collect()
    assert [r["new"] for r in got] == [r["old"] for r in got] and sum(r["old"] is None for r in got) >= 4


def test_properties_are_split_once(spark):
    text = ["a = 1; b = 2; a = 3; ", "x; = 4; c = ; d = 5 = 6;   e =  7 ", "", None]
    df = spark.createDataFrame([(t,) for t in text], "t string").select(runlog.properties(F.col("t")).alias("p"))
    assert [r["p"] for r in df.collect()] == [{"a": "3", "b": "2"}, {"c": "", "d": "5 = 6", "e": "7"}, {}, None]
    assert [r[0] for r in df.select(F.map_keys("p")).collect()] == [["a", "b"], ["c", "d", "e"], [], None]
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 2
