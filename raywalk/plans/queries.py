"""Queries over the driver tables, each with DuckDB SQL where SQL can express it.

The series is ``events`` by ``event_id``. So that both engines begin from the same doubles, the staged queries
embed it in the plane by two lagged, centred and rounded sliding sums; the whole pipeline uses principal components.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raywalk.functions import scalars
from raywalk.operators import compare, density, graph, pca, polar, runstats, scoring, windows
from raywalk.params import Params
from raywalk.plans import pipeline
from raywalk.sources import dumps, runlog, series

P = Params()
LAG, SMALL = 8, P.width
#: Measurements of a processor are some 100 s apart at sf0.1, 1 % of them under a second: nearly all are next to a grid time, which reads them.
STEP = 1_000_000
#: Transfers last whole seconds, one at least: in bins of a second every transfer counts, for as many bins as it has seconds.
CURVE = 1_000_000
CHUNK = 16_384

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_id").alias("idx"), "value")


def six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Stages in SQL: each is a CTE over the ones before it.
_RAYS = ", ".join(f"({s}, {c!r}::DOUBLE, {d!r}::DOUBLE)" for s, c, d in polar.ray_directions(P.segments))
_STAGES = {
    "series": "SELECT event_id AS idx, value FROM events",
    "conv": f"""SELECT idx, round(s, 6) AS conv FROM (
      SELECT idx, sum(value) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND {P.convolution - 1} FOLLOWING) AS s,
             count(*) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND {P.convolution} FOLLOWING) AS n FROM series) WHERE n = {P.convolution + 1}""",
    "points": f"""SELECT idx, round(conv - m, 6) AS x, round(ahead - m, 6) AS y FROM (
      SELECT idx, conv, lead(conv, {LAG}) OVER (ORDER BY idx) AS ahead FROM conv), (SELECT round(avg(conv), 3) AS m FROM conv) WHERE ahead IS NOT NULL""",
    "polar": f"""SELECT *, CAST(floor(theta / (2 * pi()) * {P.segments}) AS INTEGER) AS bucket FROM (
      SELECT *, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END AS theta FROM points)""",
    "steps": f"""SELECT *, least(least(abs(bucket - next_bucket), {P.segments} - abs(bucket - next_bucket)), {P.segments // 2}) AS diff FROM (
      SELECT *, lead(x) OVER w AS next_x, lead(y) OVER w AS next_y, lead(bucket) OVER w AS next_bucket FROM polar WINDOW w AS (ORDER BY idx)) WHERE next_bucket IS NOT NULL""",
    "candidates": f"""SELECT idx AS transition, CAST(o AS INTEGER) AS ord, CAST(((bucket - diff - 1 + o) % {P.segments} + {P.segments}) % {P.segments} AS INTEGER) AS segment, x, y, next_x, next_y
      FROM (SELECT *, unnest(range(0, 2 * (diff + 1))) AS o FROM steps)""",
    "extent": f"""SELECT *, {P.scale} * greatest(max_x, max_y) AS extent, sqrt(max_x * max_x + max_y * max_y) AS radius FROM (SELECT max(abs(x)) AS max_x, max(abs(y)) AS max_y FROM points)""",
    "rays": f"SELECT * FROM (VALUES {_RAYS}) AS r(segment, ray_cos, ray_sin)",
    "crossings": """SELECT transition, ord, segment, sqrt(cx * cx + cy * cy) AS distance FROM (
      SELECT *, px * det / div AS cx, py * det / div AS cy FROM (
        SELECT *, (-px) * (y - next_y) - (-py) * (x - next_x) AS div, x * next_y - next_x * y AS det FROM (
          SELECT c.*, radius * ray_cos AS px, radius * ray_sin AS py FROM candidates c JOIN rays r ON c.segment = r.segment, extent)) WHERE div != 0)
      WHERE cx >= least(0, px) AND cx <= greatest(0, px) AND cy >= least(0, py) AND cy <= greatest(0, py)
        AND cx >= least(x, next_x) AND cx <= greatest(x, next_x) AND cy >= least(y, next_y) AND cy <= greatest(y, next_y)""",
    "stats": "SELECT *, CASE WHEN variance > 0 THEN pow(k, 0.2) / sqrt(variance) END AS whitening FROM (SELECT segment, count(*) AS k, var_samp(distance) AS variance FROM crossings GROUP BY segment)",
    "grid": f"""SELECT segment, u, u * any_value(extent) / {P.grid} AS radius, sum(exp(-0.5 * ((distance - u * extent / {P.grid}) * whitening) * ((distance - u * extent / {P.grid}) * whitening))) / any_value(k) AS density
      FROM (SELECT c.segment, distance, k, whitening FROM crossings c JOIN stats s ON c.segment = s.segment WHERE whitening IS NOT NULL), extent, (SELECT CAST(unnest(range(0, {P.grid})) AS INTEGER) AS u) GROUP BY segment, u""",
    "nodes": """SELECT segment, CAST(row_number() OVER (PARTITION BY segment ORDER BY u) - 1 AS INTEGER) AS node, radius FROM (
      SELECT *, lag(density) OVER w AS before, lead(density) OVER w AS behind FROM grid WINDOW w AS (PARTITION BY segment ORDER BY u)) WHERE density > before AND density > behind""",
    "matched": """SELECT transition, ord, segment, distance, CAST(coalesce(node, 0) AS INTEGER) AS node FROM (
      SELECT c.transition, c.ord, c.segment, c.distance, n.node, row_number() OVER (PARTITION BY c.transition, c.ord ORDER BY abs(n.radius - c.distance), n.node) AS place
      FROM crossings c LEFT JOIN nodes n ON c.segment = n.segment) WHERE place = 1""",
    "walk": """SELECT transition, ord, from_segment, from_node, coalesce(segment, from_segment) AS to_segment, coalesce(node, from_node) AS to_node FROM (
      SELECT s.idx AS transition, coalesce(m.ord, 0) AS ord, m.segment, m.node, last_value(m.segment IGNORE NULLS) OVER w AS from_segment, last_value(m.node IGNORE NULLS) OVER w AS from_node
      FROM steps s LEFT JOIN matched m ON s.idx = m.transition WINDOW w AS (ORDER BY s.idx, m.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE from_segment IS NOT NULL""",
    "edges": "SELECT from_segment, from_node, to_segment, to_node, count(*) AS weight FROM walk GROUP BY ALL",
    "degrees": "SELECT segment, node, count(*) AS degree FROM (SELECT from_segment AS segment, from_node AS node FROM edges UNION ALL SELECT to_segment, to_node FROM edges) GROUP BY ALL",
    "slots": """SELECT transition, CAST(sum(weight * (degree - 1)) AS BIGINT) AS summands, count(*) AS edges FROM walk JOIN edges USING (from_segment, from_node, to_segment, to_node)
      JOIN degrees ON from_segment = segment AND from_node = node GROUP BY transition""",
    "paths": f"""SELECT transition AS start_idx, s / n AS score FROM (
      SELECT transition, CAST(sum(summands) OVER w AS DOUBLE) AS s, CAST(sum(edges) OVER w AS DOUBLE) AS n, count(*) OVER w AS c FROM slots WINDOW w AS (ORDER BY transition ROWS BETWEEN CURRENT ROW AND {P.query - 1} FOLLOWING)) WHERE c = {P.query}""",
    "normal": "SELECT start_idx, score, CASE WHEN most > least THEN (most - score) / (most - least) ELSE 0.0 END AS z FROM paths, (SELECT min(score) AS least, max(score) AS most FROM paths)",
    "scores": f"""SELECT start_idx, m AS anomaly_score FROM (
      SELECT start_idx, avg(z) OVER w AS m, count(*) OVER w AS c FROM normal WINDOW w AS (ORDER BY start_idx ROWS BETWEEN CURRENT ROW AND {P.length - 1} FOLLOWING)) WHERE c = {P.length}""",
    "parts": "SELECT event_id, CAST(floor(value * 700) AS BIGINT) AS heap FROM events",
    "machine": "SELECT concat('p', user_id % 4) AS processor, event_id, epoch_us(ts) AS at_us, least(value / 100.0, 1.0) AS cpu_ratio, CAST(floor(value * 1000) AS BIGINT) AS used_memory, 600000 AS max_memory, CAST(floor(value * 1000) AS BIGINT) / 600000.0 AS used_ratio FROM events",
    "spans": "SELECT event_type AS name, epoch_us(ts) AS start_us, epoch_us(ts) + (CAST(floor(value) AS BIGINT) + 1) * 1000000 AS end_us FROM events",
    "run": "SELECT min(start_us) AS start_us, max(end_us) AS end_us, (max(end_us) - min(start_us)) / 1e6 AS duration_s FROM spans",
    "moves": "SELECT event_type AS name, concat('p', (user_id // 4) % 4) AS processor, concat('p', user_id % 4) AS source, concat('p', (user_id // 4) % 4) AS sink, CAST(floor(value * 1000) AS BIGINT) AS bytes, epoch_us(ts) AS start_us, epoch_us(ts) + (CAST(floor(value) AS BIGINT) + 1) * 1000000 AS end_us FROM events",
    "phased": """SELECT name, (a - z) / 1e6 AS start_s, (b - z) / 1e6 AS end_s, (b - a) / 1e6 AS duration_s, (b - a) / 1e6 / d AS share FROM (SELECT name, min(start_us) AS a, max(end_us) AS b FROM spans GROUP BY name), (SELECT start_us AS z, duration_s AS d FROM run)""",
    "paired": """SELECT processor, event_id, at_us, at_us - start_us AS t, cpu_ratio, used_memory, used_ratio, lead(at_us - start_us) OVER w AS nt, lead(cpu_ratio) OVER w AS ncpu, lead(used_memory) OVER w AS nmem, lead(used_ratio) OVER w AS nratio,
      row_number() OVER w = 1 AS opens, end_us - start_us AS d FROM machine, run WINDOW w AS (PARTITION BY processor ORDER BY at_us, event_id)""",
    "sampled": f"""SELECT processor, k, CASE WHEN flat THEN cpu_ratio ELSE cpu_ratio * g + ncpu * (1 - g) END AS cpu, CAST(floor(CASE WHEN flat THEN CAST(used_memory AS DOUBLE) ELSE used_memory * g + nmem * (1 - g) END) AS BIGINT) AS memory,
      CASE WHEN flat THEN used_ratio ELSE used_ratio * g + nratio * (1 - g) END AS ratio FROM (
        SELECT *, nt IS NULL OR k * {STEP} < t OR nt = t AS flat, 1 - (k * {STEP} - t) / CAST(nullif(nt - t, 0) AS DOUBLE) AS g FROM (
          SELECT *, unnest(range(a, b + 1)) AS k FROM (
            SELECT *, CASE WHEN opens THEN 0 ELSE greatest(0, CAST(ceil(t / {STEP}) AS BIGINT)) END AS a, CASE WHEN nt IS NULL THEN last_k ELSE least(last_k, CAST(ceil(nt / {STEP}) AS BIGINT) - 1) END AS b
            FROM (SELECT *, (d - 1) // {STEP} AS last_k FROM paired)) WHERE b >= a))""",
    "used": f"""SELECT k * {STEP} / 1e6 AS time_s, avg(CAST(cpu AS DECIMAL(28, 18))) AS avg_cpu, min(cpu) AS min_cpu, max(cpu) AS max_cpu, CAST(sum(memory) AS BIGINT) AS total_memory, sum(memory) / 2400000.0 AS total_ratio, avg(memory) AS avg_memory, avg(memory) / 600000.0 AS avg_ratio,
      min(memory) AS min_memory, min(ratio) AS min_ratio, max(memory) AS max_memory, max(ratio) AS max_ratio FROM sampled GROUP BY k""",
    "busy": """SELECT name, processor, sum(CASE WHEN idle THEN len ELSE 0 END) AS idle_s, sum(CASE WHEN idle THEN 0 ELSE len END) AS busy_s, max(used_memory) AS max_memory, max(used_ratio) AS max_ratio, any_value(duration_s) AS duration_s FROM (
      SELECT *, (nt / 1e6 - t / 1e6) AS len, cpu_ratio < 0.05 AND ncpu < 0.05 AS idle FROM paired WHERE nt IS NOT NULL) JOIN phased ON t / 1e6 >= start_s AND t / 1e6 <= end_s GROUP BY name, processor""",
}
#: Stages that each stage reads.
_NEEDS = {
    "series": [], "conv": ["series"], "points": ["conv"], "polar": ["points"], "steps": ["polar"], "candidates": ["steps"], "extent": ["points"], "rays": [],
    "crossings": ["candidates", "rays", "extent"], "stats": ["crossings"], "grid": ["crossings", "stats", "extent"], "nodes": ["grid"], "matched": ["crossings", "nodes"],
    "walk": ["steps", "matched"], "edges": ["walk"], "degrees": ["edges"], "slots": ["walk", "edges", "degrees"], "paths": ["slots"], "normal": ["paths"], "scores": ["normal"],
    "parts": [], "machine": [], "spans": [], "run": ["spans"], "moves": [], "phased": ["spans", "run"], "paired": ["machine", "run"], "sampled": ["paired"], "used": ["sampled"], "busy": ["paired", "phased"],
}


# The principal plane in SQL: power iteration by repeated squaring, and Rodrigues' rotation, instead of the pipeline's decomposition and folded filters.
_SQUARINGS = 8
_STAGES |= {
    "sums": f"""SELECT idx, s AS conv FROM (
      SELECT idx, sum(value) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND {P.convolution - 1} FOLLOWING) AS s,
             count(*) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND {P.convolution} FOLLOWING) AS n FROM series) WHERE n = {P.convolution + 1}""",
    "lagged": f"""SELECT r.idx, r.j, s.conv AS v FROM (SELECT idx, unnest(range(0, {P.width})) AS j FROM sums WHERE idx + {P.width - 1} <= (SELECT max(idx) FROM sums)) r JOIN sums s ON s.idx = r.idx + r.j""",
    "centre": "SELECT j, avg(v) AS m FROM lagged GROUP BY j",
    "scatter0": "WITH c AS MATERIALIZED (SELECT idx, j, v - m AS v FROM lagged JOIN centre USING (j)) SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM c a JOIN c b USING (idx) GROUP BY a.j, b.j",
    "turn": """SELECT a0, a1, a2, (1 - a2) / (a0 * a0 + a1 * a1) AS f FROM (SELECT r0 / size AS a0, r1 / size AS a1, r2 / size AS a2 FROM (SELECT *, sqrt(r0 * r0 + r1 * r1 + r2 * r2) AS size FROM (
      SELECT sum(d * w0) AS r0, sum(d * w1) AS r1, sum(d * w2) AS r2 FROM (
        SELECT {c} * (SELECT min(value) FROM series) - m AS d, axis0.w AS w0, axis1.w AS w1, axis2.w AS w2 FROM centre JOIN axis0 USING (j) JOIN axis1 USING (j) JOIN axis2 USING (j)))))""".replace("{c}", str(P.convolution)),
    "filters": """SELECT j, axis0.w * (1 - a0 * a0 * f) - axis1.w * a0 * a1 * f - axis2.w * a0 AS fx, axis1.w * (1 - a1 * a1 * f) - axis0.w * a0 * a1 * f - axis2.w * a1 AS fy
      FROM axis0 JOIN axis1 USING (j) JOIN axis2 USING (j), turn""",
    "principal": "SELECT idx, sum((v - m) * fx) AS x, sum((v - m) * fy) AS y FROM lagged JOIN centre USING (j) JOIN filters USING (j) GROUP BY idx",
}
_NEEDS |= {"sums": ["series"], "lagged": ["sums"], "centre": ["lagged"], "scatter0": ["lagged", "centre"], "turn": ["series", "centre", "axis0", "axis1", "axis2"], "filters": ["axis0", "axis1", "axis2", "turn"], "principal": ["lagged", "centre", "filters"]}
for _k in range(3):
    _last = f"scatter{_k}"
    for _t in range(_SQUARINGS):
        _STAGES[f"square{_k}_{_t}"] = f"SELECT a.i, b.j, sum(a.v / t * (b.v / t)) AS v FROM {_last} a JOIN {_last} b ON a.j = b.i, (SELECT max(abs(v)) AS t FROM {_last}) GROUP BY a.i, b.j"
        _NEEDS[f"square{_k}_{_t}"] = [_last]
        _last = f"square{_k}_{_t}"
    _STAGES[f"axis{_k}"] = f"SELECT i AS j, v / sqrt(sum(v * v) OVER ()) * CASE WHEN first_value(v) OVER (ORDER BY i) < 0 THEN -1 ELSE 1 END AS w FROM {_last} WHERE j = (SELECT i FROM {_last} WHERE i = j ORDER BY v DESC, i LIMIT 1)"
    _NEEDS[f"axis{_k}"] = [_last]
    _joined = f"scatter{_k} s JOIN axis{_k} a ON s.i = a.j JOIN axis{_k} b ON s.j = b.j"
    _STAGES[f"scatter{_k + 1}"] = f"SELECT s.i, s.j, s.v - e * a.w * b.w AS v FROM {_joined}, (SELECT sum(s.v * a.w * b.w) AS e FROM {_joined})"
    _NEEDS[f"scatter{_k + 1}"] = [f"scatter{_k}", f"axis{_k}"]


def staged(final: str, *stages: str, plane: str = "points") -> str:
    """SQL with the named stages, and all that they need, before the final select. ``plane``: the stage that later ones take as ``points``."""
    texts, needs = _STAGES, _NEEDS
    if plane != "points":
        texts, needs = texts | {"points": f"SELECT idx, x, y FROM {plane}"}, needs | {"points": [plane]}
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for n in needs[name]:
            add(n)
        order.append(name)

    for s in stages:
        add(s)
    return "WITH " + ",\n".join(f"{s} AS MATERIALIZED ({texts[s]})" for s in order) + "\n" + final


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_sum(raw(spark, sf_dir), P.convolution, chunk=CHUNK).withColumn("conv", F.round("conv", 6))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = conv(spark, sf_dir)
    middle = sums.agg(F.round(F.avg("conv"), 3).alias("m"))
    ahead = windows.with_halo(sums, CHUNK, after=LAG)
    order = windows.Window.partitionBy("chunk").orderBy("idx")
    ahead = windows.own_rows(ahead.withColumn("ahead", F.lead("conv", LAG).over(order)), CHUNK).where("ahead IS NOT NULL")
    rows = ahead.join(F.broadcast(middle))
    return rows.select("idx", F.round(F.col("conv") - F.col("m"), 6).alias("x"), F.round(F.col("ahead") - F.col("m"), 6).alias("y"))


def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polar.intersections(points(spark, sf_dir), P.segments, P.scale, CHUNK)


def nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points and crossings (kept, as density, matching and edges read them) and nodes."""
    plane = pipeline.kept(points(spark, sf_dir))
    hits = pipeline.kept(polar.intersections(plane, P.segments, P.scale, CHUNK))
    return plane, hits, density.extract_nodes(hits, polar.extent(plane, P.scale), P.grid)


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane, hits, found = nodes(spark, sf_dir)
    last = plane.agg(F.max("idx").alias("last"))
    transitions = plane.join(F.broadcast(last)).where("idx < last").select(F.col("idx").alias("transition"))
    return pipeline.kept(graph.edge_events(graph.match_nodes(hits, found), transitions, CHUNK))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.path_scores(scoring.slot_summands(walk(spark, sf_dir)), P.query, CHUNK)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.anomaly_scores(paths(spark, sf_dir), P.length, CHUNK)


@query(staged("SELECT idx, value FROM series", "series"))
def series_scan(spark, sf_dir):
    """The series itself."""
    return raw(spark, sf_dir)


@query(staged("SELECT CAST(count(*) AS BIGINT) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance FROM series", "series"))
def series_stats(spark, sf_dir):
    return six(raw(spark, sf_dir).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance")), "mean", "variance")


@query("SELECT event_id AS idx, value FROM events WHERE event_id >= 100 AND event_id < 350")
def sub_range(spark, sf_dir):
    """The 250 records from position 100."""
    return raw(spark, sf_dir).where(scalars.in_range(F.col("idx"), F.lit(100), F.lit(350)))


@query("SELECT event_id AS idx, value FROM events WHERE event_id < 123")
def first_records(spark, sf_dir):
    return series.first_records(raw(spark, sf_dir), 123)


@query(staged("SELECT idx, conv FROM conv", "conv"))
def conv_sum(spark, sf_dir):
    return conv(spark, sf_dir)


@query(staged("SELECT idx, conv FROM conv", "conv"))
def conv_sum_prefix(spark, sf_dir):
    """The same sums from running sums."""
    return six(windows.sliding_sum_prefix(raw(spark, sf_dir), P.convolution, chunk=CHUNK), "conv")


_SMALL = staged(f"SELECT idx, conv AS v0, {', '.join(f'lead(conv, {j}) OVER w AS v{j}' for j in range(1, SMALL))} FROM conv WINDOW w AS (ORDER BY idx) QUALIFY v{SMALL - 1} IS NOT NULL", "conv")


@query(_SMALL)
def lag_embedding(spark, sf_dir):
    """Rows of a narrow Hankel matrix, a column for each lag."""
    rows = windows.lag_embedding(conv(spark, sf_dir), SMALL, chunk=CHUNK)
    return rows.select("idx", *(F.get("row", F.lit(j)).alias(f"v{j}") for j in range(SMALL)))


_LONG = f"WITH e AS MATERIALIZED ({_SMALL}), long AS MATERIALIZED (SELECT idx, unnest(range(0, {SMALL}))::INTEGER AS col, unnest([{', '.join(f'v{j}' for j in range(SMALL))}]) AS v FROM e)"


@query(f"{_LONG} SELECT col, round(avg(v), 4) AS mean FROM long GROUP BY col")
def column_means(spark, sf_dir):
    return pca.column_means(windows.lag_embedding(conv(spark, sf_dir), SMALL, chunk=CHUNK), SMALL).withColumn("mean", F.round("mean", 4))


@query(f"{_LONG} SELECT a.col AS i, b.col AS j, round(covar_pop(a.v, b.v), 2) AS s FROM long a JOIN long b ON a.idx = b.idx AND a.col <= b.col GROUP BY a.col, b.col")
def scatter_matrix(spark, sf_dir):
    """Cross products of the centred columns, over the number of rows."""
    rows = windows.lag_embedding(conv(spark, sf_dir), SMALL, chunk=CHUNK)
    found = pca.scatter_matrix(rows, SMALL).join(F.broadcast(rows.agg(F.count("*").alias("n"))))
    return found.select("i", "j", F.round(F.col("s") / F.col("n"), 2).alias("s"))


@query("SELECT CAST(t * n + event_id AS BIGINT) AS idx, value FROM events, (SELECT count(*) AS n FROM events), (SELECT unnest(range(0, 100)) AS t) WHERE t * n + event_id < 25000")
def replicate_series(spark, sf_dir):
    return series.replicate(raw(spark, sf_dir), "25K")


@query(staged("SELECT slice, start, least(start + size + 49, n) AS \"end\" FROM (SELECT CAST(s AS BIGINT) AS slice, CAST(s * size AS BIGINT) AS start, n, size FROM (SELECT count(*) AS n, CAST(ceil(count(*) / 4) AS BIGINT) AS size FROM series), (SELECT unnest(range(0, 4)) AS s))", "series"))
def even_slices(spark, sf_dir):
    """Slices with the overlap that subsequences need."""
    return series.slices(spark, raw(spark, sf_dir).count(), 4, P.length)


@query(staged("SELECT idx, x, y FROM points", "points"))
def planar_points(spark, sf_dir):
    return points(spark, sf_dir)


@query(staged("SELECT idx, round(theta, 6) AS theta, bucket FROM polar", "polar"))
def polar_buckets(spark, sf_dir):
    return six(polar.polar_buckets(points(spark, sf_dir), P.segments).select("idx", "theta", "bucket"), "theta")


@query(staged("SELECT idx, round(degrees(acos(greatest(-1.0, least(1.0, (x * next_x + y * next_y) / (sqrt(x * x + y * y) * sqrt(next_x * next_x + next_y * next_y)))))), 4) AS turn, round(x * next_y - next_x * y, 4) AS det, round(sqrt(x * x + y * y), 6) AS size FROM steps WHERE x * x + y * y > 0 AND next_x * next_x + next_y * next_y > 0", "steps"))
def angle_between(spark, sf_dir):
    """Angle, determinant and length of neighbouring points as vectors."""
    rows = windows.lead_pairs(points(spark, sf_dir), ["x", "y"], CHUNK).where("x * x + y * y > 0 AND next_x * next_x + next_y * next_y > 0")
    turn = scalars.angle_between(F.array("x", "y"), F.array("next_x", "next_y"))
    return rows.select("idx", F.round(F.degrees(turn), 4).alias("turn"), F.round(scalars.determinant(F.col("x"), F.col("y"), F.col("next_x"), F.col("next_y")), 4).alias("det"), F.round(scalars.length_2d(F.col("x"), F.col("y")), 6).alias("size"))


@query("""SELECT event_id AS idx, abs(value - 10) <= 1e-5 AS same, value - 10 > 1e-5 AS more, 10 - value > 1e-5 AS less, least(greatest(value, 5.0), 50.0) AS clamped,
  round(pow(CAST(event_id + 1 AS DOUBLE), -0.2), 6) AS scott, round(exp(-0.5 * (value / 50) * (value / 50)), 6) AS kernel, CAST(event_id - event_id % 7 AS BIGINT) AS multiple,
  CAST(pow(2, ceil(log2(event_id + 1))) AS BIGINT) AS power, concat('{', user_id, '_', event_id % 7, '}') AS node FROM events""")  # fmt: skip
def scalar_math(spark, sf_dir):
    """Tolerant comparison, clamping, bandwidth factor, kernel, integer helpers, node names."""
    v, i = F.col("value"), F.col("event_id")
    return events(spark, sf_dir).select(
        i.alias("idx"), scalars.is_same(v, F.lit(10.0)).alias("same"), scalars.is_more(v, F.lit(10.0)).alias("more"), scalars.is_less(v, F.lit(10.0)).alias("less"),
        scalars.clamp(v, 5.0, 50.0).alias("clamped"), F.round(scalars.scotts_factor(i + 1), 6).alias("scott"), F.round(scalars.gaussian(v / 50), 6).alias("kernel"),
        scalars.next_smaller_multiple(i, 7).alias("multiple"), scalars.next_power_of_two(i + 1).alias("power"), scalars.node_name(F.col("user_id"), i % 7).alias("node"),
    )


@query("""SELECT idx, round(a1 * b2 - a2 * b1, 6) AS cross_x, round(a2 * b0 - a0 * b2, 6) AS cross_y, round(a0 * b1 - a1 * b0, 6) AS cross_z, round(a0 * b0 + a1 * b1 + a2 * b2, 6) AS dot,
  round(a0 + u * (b0 - a0) / 4, 6) AS point, CAST(3 AS INTEGER) AS copies, a1 AS copy, round((100 - a0) / 100, 6) AS scaled, CAST(u AS INTEGER) AS u FROM (
    SELECT event_id AS idx, value AS a0, CAST(event_id % 7 AS DOUBLE) AS a1, CAST(user_id % 5 AS DOUBLE) AS a2, CAST(event_id % 3 AS DOUBLE) AS b0, value / 2 AS b1, CAST(event_id % 4 AS DOUBLE) AS b2, unnest(range(0, 4)) AS u FROM events)""")  # fmt: skip
def vector_math(spark, sf_dir):
    """Vector and scalar products, even points between two numbers, filled arrays, min-max scaling."""
    d = lambda c: c.cast("double")
    v, i = F.col("value"), F.col("event_id")
    rows = events(spark, sf_dir).select(i.alias("idx"), F.array(v, d(i % 7), d(F.col("user_id") % 5)).alias("a"), F.array(d(i % 3), v / 2, d(i % 4)).alias("b"))
    a, b, at = F.col("a"), F.col("b"), lambda c, k: F.get(c, F.lit(k))
    rows = rows.select("idx", "a", scalars.cross(a, b).alias("c"), scalars.dot(a, b).alias("dot"), scalars.filled(at(a, 1), 3).alias("f"), F.posexplode(scalars.make_range(at(a, 0), at(b, 0), 4)).alias("u", "point"))
    return rows.select(
        "idx", *(F.round(at("c", k), 6).alias(f"cross_{n}") for k, n in enumerate("xyz")), F.round("dot", 6).alias("dot"), F.round("point", 6).alias("point"), F.size("f").alias("copies"), at("f", 2).alias("copy"),
        F.round(scalars.min_max_scaled(at("a", 0), F.lit(0.0), F.lit(100.0)), 6).alias("scaled"), "u",
    )


@query(staged("SELECT transition, ord, segment FROM candidates", "candidates"))
def candidate_rays(spark, sf_dir):
    return polar.candidate_rays(points(spark, sf_dir), P.segments, CHUNK).select("transition", "ord", "segment")


@query(staged("SELECT max_x, max_y, round(extent, 6) AS extent, round(radius, 6) AS radius FROM extent", "extent"))
def extent(spark, sf_dir):
    return six(polar.extent(points(spark, sf_dir), P.scale), "extent", "radius")


@query(staged("SELECT CAST(segment AS INTEGER) AS segment, round(ray_cos, 9) AS ray_cos, round(ray_sin, 9) AS ray_sin FROM rays", "rays"))
def ray_table(spark, sf_dir):
    return polar.ray_table(spark, P.segments).withColumns({c: F.round(c, 9) for c in ("ray_cos", "ray_sin")})


@query(staged("SELECT transition, ord, segment, round(distance, 6) AS distance FROM crossings", "crossings"))
def intersections(spark, sf_dir):
    return six(crossings(spark, sf_dir), "distance")


@query(staged("SELECT segment, CAST(k AS BIGINT) AS k, round(variance, 4) AS variance, round(whitening, 6) AS whitening FROM stats", "stats"))
def segment_variance(spark, sf_dir):
    return density.segment_stats(crossings(spark, sf_dir)).select("segment", "k", F.round("variance", 4).alias("variance"), F.round("whitening", 6).alias("whitening"))


@query(staged("SELECT segment, u, round(radius, 6) AS radius, round(density, 6) AS density FROM grid", "grid"))
def density_grid(spark, sf_dir):
    plane = points(spark, sf_dir)
    hits = pipeline.kept(polar.intersections(plane, P.segments, P.scale, CHUNK))
    return six(density.density_grid(hits, polar.extent(plane, P.scale), P.grid), "radius", "density")


@query(staged("SELECT segment, u, round(radius, 6) AS radius, round(density, 6) AS density FROM grid", "grid"))
def density_grid_relational(spark, sf_dir):
    """The same densities without numpy."""
    plane = points(spark, sf_dir)
    hits = pipeline.kept(polar.intersections(plane, P.segments, P.scale, CHUNK))
    return six(density.density_grid_relational(hits, polar.extent(plane, P.scale), P.grid), "radius", "density")


@query(staged("SELECT segment, node, round(radius, 6) AS radius FROM nodes", "nodes"))
def extract_nodes(spark, sf_dir):
    return six(nodes(spark, sf_dir)[2], "radius")


@query(staged("SELECT transition, ord, segment, round(distance, 6) AS distance, node FROM matched", "matched"))
def node_match(spark, sf_dir):
    _, hits, found = nodes(spark, sf_dir)
    return six(graph.match_nodes(hits, found), "distance")


@query(staged("SELECT transition, ord, from_segment, from_node, to_segment, to_node FROM walk", "walk"))
def edge_events(spark, sf_dir):
    """Edges by the order of crossings, with loops where there is none."""
    return walk(spark, sf_dir)


@query(staged("SELECT * FROM edges", "edges"))
def edges(spark, sf_dir):
    return graph.edges(walk(spark, sf_dir))


@query(staged("SELECT concat('{', from_segment, '_', from_node, '} -[', weight, ']-> {', to_segment, '_', to_node, '}') AS edge FROM edges", "edges"))
def edge_names(spark, sf_dir):
    c = [F.col(n) for n in (*graph.ENDS, "weight")]
    return graph.edges(walk(spark, sf_dir)).select(scalars.edge_name(*c).alias("edge"))


@query(staged("SELECT * FROM degrees", "degrees"))
def node_degrees(spark, sf_dir):
    return graph.node_degrees(graph.edges(walk(spark, sf_dir)))


@query(staged("SELECT count(*) AS edges, CAST(sum(weight) AS BIGINT) AS total_weight, (SELECT count(*) FROM degrees) AS nodes FROM edges", "edges", "degrees"))
def graph_summary(spark, sf_dir):
    return graph.graph_summary(graph.edges(walk(spark, sf_dir)))


@query(staged("SELECT * FROM slots", "slots"))
def slot_summands(spark, sf_dir):
    return scoring.slot_summands(walk(spark, sf_dir))


@query(staged("SELECT start_idx, round(score, 6) AS score FROM paths", "paths"))
def path_scores(spark, sf_dir):
    return six(paths(spark, sf_dir), "score")


@query(staged("SELECT start_idx, round(score, 6) AS score FROM paths", "paths"))
def path_scores_prefix(spark, sf_dir):
    """The same scores from running sums."""
    return six(scoring.path_scores(scoring.slot_summands(walk(spark, sf_dir)), P.query, CHUNK, running=True), "score")


@query(staged("SELECT start_idx, round(z, 6) AS z FROM normal", "normal"))
def normalized_scores(spark, sf_dir):
    return six(windows.normalised(paths(spark, sf_dir), "score", "z").select("start_idx", "z"), "z")


@query(staged("SELECT start_idx, round(anomaly_score, 6) AS anomaly_score FROM scores", "scores"))
def running_mean(spark, sf_dir):
    return six(scores(spark, sf_dir), "anomaly_score")


@query(staged("SELECT start_idx, round(anomaly_score, 6) AS anomaly_score FROM scores", "scores"))
def running_mean_prefix(spark, sf_dir):
    """The same means from running sums."""
    z = windows.normalised(paths(spark, sf_dir), "score", "z")
    return six(windows.running_mean_prefix(z, "z", P.length, "anomaly_score", "start_idx", CHUNK), "anomaly_score")


@query(staged("SELECT start_idx, round(anomaly_score, 6) AS anomaly_score FROM scores ORDER BY scores.anomaly_score DESC, start_idx LIMIT 10", "scores"))
def topk_anomalies(spark, sf_dir):
    return six(scoring.top_anomalies(scores(spark, sf_dir), 10), "anomaly_score")


@query("""WITH a AS (SELECT event_id AS i, value AS v FROM events), b AS (SELECT event_id - 5 AS i, round(value, 1) AS v FROM events)
SELECT count(*) FILTER (a.i IS NOT NULL AND b.i IS NOT NULL) AS compared, round(max(abs(a.v - b.v)), 6) AS max_difference, round(avg(abs(a.v - b.v)), 6) AS avg_difference,
       count(*) FILTER (b.i IS NULL) AS only_left, count(*) FILTER (a.i IS NULL) AS only_right FROM a FULL JOIN b ON a.i = b.i""")
def score_diff(spark, sf_dir):
    """The series against itself, five positions on and rounded to a digit."""
    a = raw(spark, sf_dir).toDF("start_idx", "anomaly_score")
    b = a.select((F.col("start_idx") - 5).alias("start_idx"), F.round("anomaly_score", 1).alias("anomaly_score"))
    return six(compare.score_diff(a, b), "max_difference", "avg_difference")


@query(staged("SELECT count(*) AS compared, round(max(abs(radius - r2)), 6) AS max_difference, round(avg(abs(radius - r2)), 6) AS avg_difference, 0::BIGINT AS only_left, 0::BIGINT AS only_right FROM (SELECT radius, round(radius, 2) AS r2 FROM nodes)", "nodes"))
def node_diff(spark, sf_dir):
    """Nodes against their dump, rounded to two digits and parsed again."""
    found = nodes(spark, sf_dir)[2]
    lines = found.select(F.format_string("{%d_%d} %s", "segment", "node", F.round("radius", 2).cast("string")).alias("value"))
    return six(compare.node_diff(found, dumps.parse_nodes(lines)), "max_difference", "avg_difference")


@query(f"""WITH e AS ({_SMALL}), a AS (SELECT idx, unnest(range(0, {SMALL})) AS col, unnest([{", ".join(f"v{j}" for j in range(SMALL))}]) AS v FROM e)
SELECT count(*) AS compared, round(max(abs(v - round(v, 1))), 6) AS max_difference, round(avg(abs(v - round(v, 1))), 4) AS avg_difference, 0::BIGINT AS only_left, 0::BIGINT AS only_right FROM a""")
def matrix_diff(spark, sf_dir):
    """A Hankel matrix against itself rounded to a digit."""
    rows = windows.lag_embedding(conv(spark, sf_dir), SMALL, chunk=CHUNK)
    left = rows.select(F.col("idx").alias("row"), F.posexplode("row").alias("col", "value"))
    found = compare.matrix_diff(left, left.withColumn("value", F.round("value", 1)))
    return found.withColumns({"max_difference": F.round("max_difference", 6), "avg_difference": F.round("avg_difference", 4)})


@query(f"""{_LONG}, s AS (SELECT round(covar_pop(a.v, b.v), 2) AS s FROM long a JOIN long b ON a.idx = b.idx GROUP BY a.col, b.col)
SELECT count(*) AS compared, round(max(abs(s)), 2) AS max_difference, round(avg(abs(s)), 4) AS avg_difference, 0::BIGINT AS only_left, 0::BIGINT AS only_right FROM s""")
def matrix_diff_binary(spark, sf_dir):
    """The scatter matrix, a row for each lag, against its double: one dumped as text, one in binary, both read again."""
    matrix = np.zeros((SMALL, SMALL))
    for i, j, v in scatter_matrix(spark, sf_dir).collect():
        matrix[i, j] = matrix[j, i] = v
    path = f"{folder(spark)}/matrix-{uuid.uuid4().hex}"
    dumps.write_matrix(matrix, f"{path}/text")
    dumps.write_matrix(2 * matrix, f"{path}/binary", binary=True)
    found = compare.matrix_diff(dumps.read_matrix(spark, f"{path}/text"), dumps.read_matrix(spark, f"{path}/binary"))
    return found.withColumns({"max_difference": F.round("max_difference", 2), "avg_difference": F.round("avg_difference", 4)})


def wall_micros(column: str = "ts") -> Column:
    """Microseconds of a wall-clock time, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as measurements of four processors."""
    used = F.floor(F.col("value") * 1000).cast("long")
    heap = F.floor(F.col("value") * 700).cast("long")
    return events(spark, sf_dir).select(
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("processor"), "event_id", wall_micros().alias("at_us"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("cpu_ratio"),
        used.alias("used_memory"), F.lit(600000).cast("long").alias("max_memory"), (used / 600000.0).alias("used_ratio"),
        heap.alias("heap"), (used - heap).alias("stack"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as durations of their kinds."""
    start = wall_micros()
    return events(spark, sf_dir).select(F.col("event_type").alias("name"), start.alias("start_us"), (start + (F.floor("value").cast("long") + 1) * 1000000).alias("end_us"))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as transfers between processors, as their receivers report them."""
    p = lambda c: F.concat(F.lit("p"), c.cast("long").cast("string"))
    start = wall_micros()
    sink = p(F.floor(F.col("user_id") / 4) % 4)
    return events(spark, sf_dir).select(F.col("event_type").alias("name"), sink.alias("processor"), p(F.col("user_id") % 4).alias("source"), sink.alias("sink"), F.floor(F.col("value") * 1000).cast("long").alias("bytes"), start.alias("start_us"), (start + (F.floor("value").cast("long") + 1) * 1000000).alias("end_us"))


ORDER = ["at_us", "event_id"]


def total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runstats.total_time(spans(spark, sf_dir))


def sampled(spark: SparkSession, sf_dir: str, swapped: bool = False) -> DataFrame:
    run = total(spark, sf_dir).select("start_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"))
    return runstats.resampled(machine(spark, sf_dir), F.col("start_us"), F.col("duration_us"), run, STEP, ORDER, swapped)


def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runstats.cluster_utilisation(sampled(spark, sf_dir), runstats.max_memory(machine(spark, sf_dir), ORDER), STEP)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def _rounded(columns: str, source: str, exact: str = "", digits: int = 6) -> str:
    """SELECT of exact columns, and of double columns rounded."""
    return "SELECT " + ", ".join([*([exact] if exact else []), *(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in columns.split(","))]) + f" FROM {source}"


@query(staged(_rounded("duration_s", "run", "start_us, end_us"), "run"))
def overall_time(spark, sf_dir):
    return rounded(total(spark, sf_dir))


@query(staged("SELECT processor, CAST(arg_min(used_memory, (at_us, event_id)) AS BIGINT) AS max_memory FROM machine GROUP BY processor", "machine"))
def max_memory(spark, sf_dir):
    """The first measurement of each processor."""
    return runstats.max_memory(machine(spark, sf_dir), ORDER, "used_memory")


@query(staged(_rounded("start_s, end_s, duration_s, share", "phased", "name"), "phased"))
def phase_durations(spark, sf_dir):
    return rounded(runstats.phases(spans(spark, sf_dir), total(spark, sf_dir)))


@query(staged(_rounded("cpu, ratio", "sampled", "processor, CAST(k AS BIGINT) AS k, memory"), "sampled"))
def resampled_util(spark, sf_dir):
    """Measurements interpolated on an even time grid."""
    return rounded(sampled(spark, sf_dir))


@query(staged(_rounded("time_s, avg_cpu, min_cpu, max_cpu, total_ratio, avg_memory, avg_ratio, min_ratio, max_ratio", "used", "total_memory, min_memory, max_memory", 9), "used"))
def cluster_util(spark, sf_dir):
    return rounded(used(spark, sf_dir), 9)


@query(staged(_rounded("cpu, ratio", "(SELECT processor, k, CASE WHEN flat THEN cpu_ratio ELSE cpu_ratio * (1 - g) + ncpu * g END AS cpu, CASE WHEN flat THEN used_ratio ELSE used_ratio * (1 - g) + nratio * g END AS ratio FROM ("
    + _STAGES["sampled"][_STAGES["sampled"].index("SELECT *, nt IS NULL"):], "processor, CAST(k AS BIGINT) AS k") + ")", "paired"))
def resampled_swapped(spark, sf_dir):
    """The same grid with the weights of older reports."""
    return rounded(sampled(spark, sf_dir, swapped=True).select("processor", "k", "cpu", "ratio"))


@query(staged(_rounded("start_s, end_s, duration_s, duration_share, volume_share, rate, max_share, min_share", """(
  SELECT name, (a - z) / 1e6 AS start_s, (b - z) / 1e6 AS end_s, (b - a) / 1e6 AS duration_s, (b - a) / 1e6 / d AS duration_share, volume, volume / CAST(sum(volume) OVER () AS DOUBLE) AS volume_share, volume / ((b - a) / 1e6) AS rate,
         max_volume, max_volume / CAST(volume AS DOUBLE) AS max_share, min_volume, min_volume / CAST(volume AS DOUBLE) AS min_share, processors
  FROM (SELECT name, CAST(sum(r) AS BIGINT) AS volume, CAST(max(r) AS BIGINT) AS max_volume, CAST(min(r) AS BIGINT) AS min_volume, count(*) AS processors FROM (
          SELECT name, who, sum(CASE WHEN sink = who AND processor = who THEN bytes ELSE 0 END) AS r FROM (SELECT *, unnest([source, sink]) AS who FROM moves WHERE source != sink) GROUP BY name, who) GROUP BY name HAVING sum(r) > 0)
  JOIN (SELECT name, min(start_us) AS a, max(end_us) AS b FROM moves GROUP BY name) USING (name), (SELECT start_us AS z, duration_s AS d FROM run))""", "name, volume, max_volume, min_volume, processors"), "moves", "run"))  # fmt: skip
def transfer_stats(spark, sf_dir):
    return rounded(runstats.transfer_stats(moves(spark, sf_dir), total(spark, sf_dir)))


@query(staged(f"""SELECT processor, round(k * {CURVE} / 1e6, 6) AS time_s, sent, received, looped, round(sent / ({CURVE} / 1e6 * 1048576), 6) AS sent_mib_s, round(received / ({CURVE} / 1e6 * 1048576), 6) AS received_mib_s, CAST(sum(sent) OVER w AS BIGINT) AS sent_total, CAST(sum(received) OVER w AS BIGINT) AS received_total, CAST(sum(looped) OVER w AS BIGINT) AS looped_total FROM (
  SELECT processor, k, coalesce(sent, 0) AS sent, coalesce(received, 0) AS received, coalesce(looped, 0) AS looped FROM (
    SELECT processor, unnest(range(0, greatest(1, CAST(ceil((e - z) / {CURVE}) AS BIGINT)))) AS k FROM (SELECT source AS processor FROM moves UNION SELECT sink FROM moves), (SELECT start_us AS z, end_us AS e FROM run)) LEFT JOIN (
  SELECT processor, k, CAST(sum(CASE WHEN way = 'sent' THEN part ELSE 0 END) AS BIGINT) AS sent, CAST(sum(CASE WHEN way = 'received' THEN part ELSE 0 END) AS BIGINT) AS received, CAST(sum(CASE WHEN way = 'loop' THEN part ELSE 0 END) AS BIGINT) AS looped FROM (
    SELECT unnest(CASE WHEN source = sink THEN [source] ELSE [source, sink] END) AS processor, unnest(CASE WHEN source = sink THEN ['loop'] ELSE ['sent', 'received'] END) AS way, k, part FROM (
      SELECT *, unnest(range(greatest(1, CAST(floor((start_us - z) / {CURVE}) AS BIGINT) + 1), CAST(ceil(least(end_us - z, e - z) / {CURVE}) AS BIGINT))) AS k, CAST(floor(bytes * {CURVE}.0::DOUBLE / (end_us - start_us)) AS BIGINT) AS part
      FROM moves, (SELECT start_us AS z, end_us AS e FROM run))) GROUP BY processor, k) USING (processor, k)) WINDOW w AS (PARTITION BY processor ORDER BY k)""", "moves", "run"))  # fmt: skip
def transfer_curves(spark, sf_dir):
    """Traffic at every grid time, with running totals."""
    return rounded(runstats.transfer_curves(moves(spark, sf_dir), total(spark, sf_dir), CURVE))


@query(staged(_rounded("idle_s, idle_share, busy_s, busy_share, max_ratio", "(SELECT *, idle_s / duration_s AS idle_share, busy_s / duration_s AS busy_share FROM busy)", "name, processor, max_memory"), "busy"))
def idle_busy(spark, sf_dir):
    run = total(spark, sf_dir)
    return rounded(runstats.processor_phases(machine(spark, sf_dir), runstats.phases(spans(spark, sf_dir), run), run, ORDER))


@query(staged(_rounded("duration_s, summed_s, avg_cpu, avg_memory, avg_ratio, max_ratio, idle_s, idle_share, avg_idle_s, max_idle_s, max_idle_share, busy_s, busy_share, avg_busy_s, max_busy_s, max_busy_share", """(
  SELECT p.name, p.duration_s, p.duration_s * 4 AS summed_s, u.avg_cpu, u.avg_memory, u.avg_ratio, u.max_memory, u.max_ratio, idle_s, idle_s / (p.duration_s * 4) AS idle_share, idle_s / 4 AS avg_idle_s, max_idle_s, max_idle_s / p.duration_s AS max_idle_share,
         busy_s, busy_s / (p.duration_s * 4) AS busy_share, busy_s / 4 AS avg_busy_s, max_busy_s, max_busy_s / p.duration_s AS max_busy_share
  FROM phased p LEFT JOIN (SELECT name, avg(avg_cpu) AS avg_cpu, avg(avg_memory) AS avg_memory, avg(avg_ratio) AS avg_ratio, max(max_memory) AS max_memory, max(max_ratio) AS max_ratio FROM used JOIN phased ON time_s >= start_s AND time_s <= end_s GROUP BY name) u ON p.name = u.name
  LEFT JOIN (SELECT name, sum(idle_s) AS idle_s, max(idle_s) AS max_idle_s, sum(busy_s) AS busy_s, max(busy_s) AS max_busy_s FROM busy GROUP BY name) b ON p.name = b.name)""", "name, max_memory"), "used", "phased", "busy"))  # fmt: skip
def step_stats(spark, sf_dir):
    run, m = total(spark, sf_dir), machine(spark, sf_dir)
    steps = runstats.phases(spans(spark, sf_dir), run)
    each = runstats.processor_phases(m, steps, run, ORDER)
    count = runstats.max_memory(m, ORDER).agg(F.count("*").alias("n"))
    return rounded(runstats.phase_stats(steps, used(spark, sf_dir), each, count))


_TIMED = "(SELECT m.*, heap, used_memory - heap AS stack, heap / 600000.0 AS heap_ratio, (used_memory - heap) / 600000.0 AS stack_ratio, (at_us - z) / 1e6 AS time_s FROM machine m JOIN parts USING (event_id), (SELECT start_us AS z FROM run))"


@query(staged(_rounded("time_s, cpu_ratio, used_ratio, heap_ratio, stack_ratio", _TIMED, "processor, used_memory"), "machine", "run", "parts"))
def machine_series(spark, sf_dir):
    return rounded(runstats.machine_series(machine(spark, sf_dir), total(spark, sf_dir)))


@query(staged(f"""SELECT processor, max(cpu_ratio) AS max_cpu, round(arg_max(time_s, (cpu_ratio, -at_us, -event_id)), 6) AS max_cpu_at_s, max(used_memory) AS max_used, round(arg_max(time_s, (used_memory, -at_us, -event_id)), 6) AS max_used_at_s,
  round(max(heap_ratio), 6) AS max_heap, round(arg_max(time_s, (heap_ratio, -at_us, -event_id)), 6) AS max_heap_at_s, round(max(stack_ratio), 6) AS max_stack, round(arg_max(time_s, (stack_ratio, -at_us, -event_id)), 6) AS max_stack_at_s
  FROM {_TIMED} GROUP BY processor""", "machine", "run", "parts"))  # fmt: skip
def machine_peaks(spark, sf_dir):
    return rounded(runstats.machine_peaks(machine(spark, sf_dir), total(spark, sf_dir), ORDER))


def log_file(spark: SparkSession, sf_dir: str, body: Column) -> DataFrame:
    """Write ``events`` as lines of a run log to the session's shared folder and read the files back."""
    line = F.concat(F.lit("["), F.date_format(F.col("ts").cast("timestamp"), runlog.TIME), F.lit("]  -  "), body)
    path = f"{folder(spark)}/log-{uuid.uuid4().hex}"
    events(spark, sf_dir).select(line).write.text(path)
    return runlog.read_log(spark, path)


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="raywalk-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _stamped(kind: str, *fields: tuple[str, Column]) -> Column:
    parts = [F.lit(f"{kind} {{ Processor = p"), (F.col("user_id") % 4).cast("string"), F.lit("; DateTime = "), F.date_format(F.col("ts").cast("timestamp"), runlog.TIME)]
    for name, value in fields:
        parts += [F.lit(f"; {name} = "), value.cast("string")]
    return F.concat(*parts, F.lit("; }"))


_MILLIS = "(epoch_us(ts) // 1000) * 1000"


@query(f"""WITH q AS (SELECT concat('p', user_id % 4) AS processor, concat('p', (user_id // 4) % 4) AS remote, {_MILLIS} AS m_us, event_id FROM events)
SELECT processor, remote, CAST(m_us - min(m_us) OVER (PARTITION BY processor, remote) AS BIGINT) AS time_us, event_id AS enqueued, event_id % 7 AS unacknowledged, event_id % 11 AS largest_queue, remote AS largest_receiver, (event_id % 13) / 2.0::DOUBLE AS average_enqueued FROM q""")
def message_exchange(spark, sf_dir):
    """Measurements of the message exchange, through a log file."""
    i, remote = F.col("event_id"), F.concat(F.lit("p"), (F.floor(F.col("user_id") / 4) % 4).cast("string"))
    lines = log_file(spark, sf_dir, _stamped("MessageExchangeUtilization", ("RemoteProcessor", remote), ("TotalNumberOfEnqueuedMessages", i), ("TotalNumberOfUnacknowledgedMessages", i % 7), ("LargestMessageQueueSize", i % 11), ("LargestMessageQueueReceiver", remote), ("AverageNumberOfEnqueuedMessages", (i % 13) / 2)))
    return runstats.exchange_series(pipeline.kept(runlog.message_queues(lines).withColumn("at_us", F.unix_micros("date_time"))))


@query(f"""WITH q AS (SELECT concat('p', user_id % 4) AS processor, {_MILLIS} AS m_us, event_id % 9 AS workers, event_id % 9 // 2 AS available, event_id AS queue FROM events)
SELECT processor, CAST(m_us - min(m_us) OVER (PARTITION BY processor) AS BIGINT) AS time_us, workers, available, CASE WHEN workers > 0 THEN round((workers - available) / workers, 6) END AS workers_ratio, queue FROM q""")
def pool_use(spark, sf_dir):
    """Measurements of the worker pools, through a log file."""
    i = F.col("event_id")
    lines = log_file(spark, sf_dir, _stamped("ActorPoolUtilization", ("Workers", i % 9), ("AvailableWorkers", F.floor(i % 9 / 2)), ("QueueSize", i)))
    return rounded(runstats.pool_series(pipeline.kept(runlog.pools(lines).withColumn("at_us", F.unix_micros("date_time")))))


@query("SELECT event_id AS idx, value FROM events")
def binary_round_trip(spark, sf_dir):
    """The series written as big-endian binary files and scanned again."""
    return series.read_binary(spark, binary_file(spark, sf_dir))


@query("SELECT event_id AS idx, value FROM events WHERE event_id >= 100 AND event_id < 350")
def binary_range(spark, sf_dir):
    """A range of records, by its bytes."""
    return series.read_binary(spark, binary_file(spark, sf_dir), start=100, length=250)


@query("SELECT event_id AS idx, round(value, 3) AS value FROM events")
def text_round_trip(spark, sf_dir):
    """The series written as text, a number a line, and read again by the order of lines."""
    path = f"{folder(spark)}/text-{uuid.uuid4().hex}"
    series.write_text(raw(spark, sf_dir).withColumn("value", F.round("value", 3)), path)
    return series.read_text(spark, path)


@query("SELECT CAST(count(*) AS BIGINT) AS records FROM events")
def line_count(spark, sf_dir):
    """Lines of a text file of the series."""
    path = f"{folder(spark)}/text-{uuid.uuid4().hex}"
    series.write_text(raw(spark, sf_dir), path)
    return spark.range(1).select(F.lit(series.line_count(spark, path)).cast("long").alias("records"))


def binary_file(spark: SparkSession, sf_dir: str) -> str:
    path = f"{folder(spark)}/series-{uuid.uuid4().hex}"
    series.write_binary(raw(spark, sf_dir), path)
    return path


_LINE = "concat('[', strftime(ts, '%Y/%m/%d %H:%M:%S.'), lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0'), ']  -  MachineUtilization { Processor = p', user_id % 4, '; MaximumMemory = 600000; UsedHeap = ', event_id * 3, '; UsedStack = ', user_id, '; CPULoad = 0.25; UsedStack = 7; }')"


@query(f"""WITH lines AS (SELECT event_id, {_LINE} AS line FROM events)
SELECT event_id, CAST(epoch_ms(strptime(regexp_extract(line, '^\\[([^\\]]*)\\]', 1), '%Y/%m/%d %H:%M:%S.%g')) AS BIGINT) AS at_ms, regexp_extract(line, '  -  (\\w+) \\{{', 1) AS event, regexp_extract(line, 'Processor = ([^;]*);', 1) AS processor,
       CAST(regexp_extract(line, 'UsedHeap = (\\d+);', 1) AS BIGINT) + 7 AS used_memory, 5::BIGINT AS properties FROM lines""")
def log_parse(spark, sf_dir):
    """Lines of a run log, made from ``events`` and parsed again; the last of a repeated key counts."""
    at = F.col("ts").cast("timestamp")
    line = F.concat(F.lit("["), F.date_format(at, runlog.TIME), F.lit("]  -  MachineUtilization { Processor = p"), (F.col("user_id") % 4).cast("string"), F.lit("; MaximumMemory = 600000; UsedHeap = "), (F.col("event_id") * 3).cast("string"), F.lit("; UsedStack = "), F.col("user_id").cast("string"), F.lit("; CPULoad = 0.25; UsedStack = 7; }"))
    rows = runlog.parse_log(events(spark, sf_dir).select("event_id", line.alias("value")))
    p = F.col("props")
    return rows.select("event_id", F.floor(wall_micros() / 1000).cast("long").alias("at_ms"), "event", p["Processor"].alias("processor"), (p["UsedHeap"].cast("long") + p["UsedStack"].cast("long")).alias("used_memory"), F.size("props").cast("long").alias("properties"))


@query(staged("SELECT idx, round(x, 3) AS x, round(y, 3) AS y FROM points", "points", plane="principal"))
def trajectory(spark, sf_dir):
    """Points of the principal plane, to three places."""
    detector = pipeline.Detector(raw(spark, sf_dir), P)
    return detector.trajectory(detector.fit()).select("idx", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(staged("SELECT * FROM edges", "edges", plane="principal"))
def model_edges(spark, sf_dir):
    """Edges of the graph from the principal plane."""
    model = pipeline.Detector(raw(spark, sf_dir), P).fit()
    return spark.createDataFrame(model.edge_rows(), "from_segment int, from_node int, to_segment int, to_node int, weight long")


@query(staged("SELECT start_idx, round(anomaly_score, 6) AS anomaly_score FROM scores", "scores", plane="principal"))
def anomaly_scores(spark, sf_dir):
    """The whole detection."""
    return six(pipeline.detect(raw(spark, sf_dir), P), "anomaly_score")


@query(staged("SELECT start_idx, round(anomaly_score, 6) AS anomaly_score FROM scores", "scores", plane="principal"))
def anomaly_scores_naive(spark, sf_dir):
    """The whole detection with every frame added up anew."""
    return six(pipeline.detect(raw(spark, sf_dir), Params(naive=True)), "anomaly_score")
