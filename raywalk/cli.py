"""Command line: ``python -m raywalk.cli convert|replicate|detect|diff|report``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from raywalk.operators import compare, runstats
from raywalk.params import Params
from raywalk.plans.pipeline import detect
from raywalk.session import local_session
from raywalk.sources import dumps, runlog, series


def _read(spark, path: str):
    return series.read_text(spark, path) if path.endswith((".txt", ".text", ".csv")) else series.read_binary(spark, path)


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="raywalk")
    top.add_argument("--config", help="JSON file with defaults for the options below")
    sub = top.add_subparsers(dest="command", required=True)
    convert = sub.add_parser("convert", help="text series to binary, or back")
    repeat = sub.add_parser("replicate", help="repeat a series up to a size such as 10M")
    find = sub.add_parser("detect", help="score the subsequences of a series")
    diff = sub.add_parser("diff", help="compare two results")
    report = sub.add_parser("report", help="statistics of a run log")
    for p in (convert, repeat, find, report):
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
    repeat.add_argument("--size", required=True)
    default = Params()
    find.add_argument("--sub-sequence-length", type=int, default=default.length)
    find.add_argument("--convolution-size", type=int, default=default.convolution)
    find.add_argument("--intersection-segments", type=int, default=default.segments)
    find.add_argument("--query-length", type=int, default=default.query)
    find.add_argument("--single-file", action="store_true")
    find.add_argument("--naive", action="store_true", help="add up every frame anew instead of keeping running sums")
    find.add_argument("--distribution", default="", help="accepted and ignored: Spark deals out the work")
    find.add_argument("--work-load-factor", type=float, default=1.0, help="accepted and ignored")
    diff.add_argument("left")
    diff.add_argument("right")
    diff.add_argument("--kind", choices=["scores", "nodes", "matrix"], default="scores")
    report.add_argument("--step-ms", type=int, default=50)
    known, _ = top.parse_known_args(args)
    if known.config:
        with open(known.config) as f:
            settings = json.load(f)
        for p in (convert, repeat, find, diff, report):
            p.set_defaults(**settings)
    o = top.parse_args(args)
    spark = local_session()
    if o.command == "convert":
        if o.input.endswith((".txt", ".text", ".csv")):
            series.write_binary(series.read_text(spark, o.input), o.output)
        else:
            series.write_text(series.read_binary(spark, o.input), o.output)
    elif o.command == "replicate":
        series.write_binary(series.replicate(_read(spark, o.input), o.size), o.output)
    elif o.command == "detect":
        p = Params(o.sub_sequence_length, o.convolution_size, o.intersection_segments, o.query_length, naive=o.naive)
        series.write_text(detect(_read(spark, o.input), p), o.output, "anomaly_score", "start_idx", o.single_file)
    elif o.command == "diff":
        if o.kind == "nodes":
            found = compare.node_diff(dumps.read_nodes(spark, o.left), dumps.read_nodes(spark, o.right))
        elif o.kind == "matrix":
            found = compare.matrix_diff(dumps.read_matrix(spark, o.left), dumps.read_matrix(spark, o.right))
        else:
            left, right = (series.read_text(spark, p).toDF("start_idx", "anomaly_score") for p in (o.left, o.right))
            found = compare.score_diff(left, right)
        print(json.dumps(found.first().asDict()))
    else:
        events = runlog.read_log(spark, o.input)
        spans = runlog.durations(events).select(F.col("event").alias("name"), F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"))
        total = runstats.total_time(spans.where("name = 'CalculationCompleted'"))
        machine = runlog.machine(events).withColumn("at_us", F.unix_micros("date_time"))
        steps = runstats.phases(spans.where("name NOT IN ('DataTransferred', 'CalculationCompleted')"), total)
        step = o.step_ms * 1000
        run = total.select("start_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"))
        grid = runstats.resampled(machine, F.col("start_us"), F.col("duration_us"), run, step, ["date_time"])
        memory = runstats.max_memory(machine, ["date_time"])
        use = runstats.cluster_utilisation(grid, memory, step)
        each = runstats.processor_phases(machine, steps, total, ["date_time"])
        moved = runlog.transfers(events).select("name", "processor", "source", "sink", "bytes", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"))
        tables = {
            "process-steps": (steps, "start_s"), "cluster-utilisation": (use, "time_s"), "transfers": (runstats.transfer_stats(moved, total), "start_s"),
            "processor-steps": (each, "name"), "step-statistics": (runstats.phase_stats(steps, use, each, memory.agg(F.count("*").alias("n"))), "name"),
            "transfer-curves": (runstats.transfer_curves(moved, total, step), "time_s"), "machine-peaks": (runstats.machine_peaks(machine, total, ["date_time"]), "processor"),
            "machine-series": (runstats.machine_series(machine, total), "time_s"),
            "message-exchange": (runstats.exchange_series(runlog.message_queues(events).withColumn("at_us", F.unix_micros("date_time"))), "time_us"),
            "pools": (runstats.pool_series(runlog.pools(events).withColumn("at_us", F.unix_micros("date_time"))), "time_us"),
        }
        for name, (rows, order) in tables.items():
            series.write_csv(rows, f"{o.output}/{name}", order)
    return 0


if __name__ == "__main__":
    sys.exit(main())
