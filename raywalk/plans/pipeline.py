"""The whole detection: fit a model of a series, score series with it.

The series is packed into chunk rows: a chunk's records and as many after its end as any of its results can
depend on. Each pass maps chunk rows with numpy; between passes only bounded aggregates reach the
driver: a width x width matrix, the extent, grid sums of each ray, the graph's edges, and the ends of the scores.
Crossings are written once, with the pass that needs them first, where a shared folder is set; else they are cached.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from raywalk.operators import numeric
from raywalk.operators.pca import trajectory_filters
from raywalk.operators.polar import ray_directions
from raywalk.params import Params
from raywalk.session import ship

CROSSED = "chunk long, count int, transition array<int>, segment array<int>, distance array<double>"


@dataclass
class Model:
    """What a series has taught: filters to the plane, extent, nodes of each ray, edge weights and degrees."""

    params: Params
    filters: np.ndarray
    offsets: np.ndarray
    extent: float
    radius: float
    nodes: list[np.ndarray]
    start: np.ndarray  # number of each ray's first node; rays without nodes have one
    weights: dict[int, int] = field(default_factory=dict)  # from * number of nodes + to: weight
    degrees: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def size(self) -> int:
        return int(self.start[-1])

    def number(self, segment: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Number of the node of each crossing."""
        out = np.zeros(len(segment), np.int64)
        order = np.argsort(segment, kind="stable")
        ends = np.searchsorted(segment[order], np.arange(len(self.nodes) + 1))
        for s in range(len(self.nodes)):
            own = order[ends[s] : ends[s + 1]]
            if len(own):
                out[own] = numeric.nearest(distance[own], self.nodes[s]) + self.start[s]
        return out

    def names(self) -> list[tuple[int, int]]:
        """(segment, node) of each number."""
        return [(s, i) for s in range(len(self.nodes)) for i in range(self.start[s + 1] - self.start[s])]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted edge numbers and the summand weight * (degree - 1) of each."""
        keys = np.array(sorted(self.weights), np.int64)
        summands = np.array([self.weights[k] for k in keys.tolist()], np.float64) * (self.degrees[keys // max(self.size, 1)] - 1) if len(keys) else np.zeros(0)
        return keys, summands

    def edge_rows(self) -> list[tuple[int, int, int, int, int]]:
        names = self.names()
        return [(*names[k // self.size], *names[k % self.size], w) for k, w in sorted(self.weights.items())]


def pack(series: DataFrame, params: Params, chunk: int) -> DataFrame:
    """Chunk rows from (idx, value). One shuffle; the overlap is repeated, not exchanged later."""
    halo = params.reach + params.convolution
    if chunk < halo:
        raise ValueError(f"a chunk must have {halo} records at least")
    at = F.col("idx")
    own = F.floor(at / chunk).cast("long")
    both = F.when((at % chunk < halo) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = series.select(F.explode(both).alias("chunk"), F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))
    rows = rows.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("r"))
    return rows.select("chunk", F.col("r.value").alias("records"))


def kept(df: DataFrame) -> DataFrame:
    """Keep a result for later passes: as Parquet in the session's checkpoint folder, or cached where none is set."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder.rstrip('/')}/walk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _mapped(packed: DataFrame, function: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Apply a function of one chunk row's arrays; it returns rows."""
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in T._parse_datatype_string(schema).fields])
    columns = packed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {}
                for c in columns:
                    cell = batch.column(c)[i]
                    row[c] = cell.values.to_numpy(zero_copy_only=False) if isinstance(cell, pa.ListScalar) else cell.as_py()
                found = function(row)
                if found:
                    yield pa.RecordBatch.from_pydict({f.name: pa.array([r[f.name] for r in found], f.type) for f in arrow}, schema=arrow)

    return packed.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[kind.simpleString()]


class Detector:
    """Passes over one series. ``series``: idx (dense from 0) and value."""

    def __init__(self, series: DataFrame, params: Params = Params(), check: bool = True):
        self.params, self.spark = params, series.sparkSession
        ship(self.spark)
        stats = series.agg(F.count("*"), F.min("idx"), F.max("idx"), F.min("value"), F.count("value"), F.count_if(F.isnan("value") | (F.abs("value") == float("inf")))).first()
        self.n, low, high, self.least, valued, odd = stats
        params.check_length(self.n)
        if check and (low != 0 or high != self.n - 1):
            raise ValueError("idx must be dense from 0")
        if valued != self.n or odd:
            raise ValueError("the series has null or non-finite values")
        self.least = float(self.least)
        self.chunk = params.chunk_for(self.n, self.spark.sparkContext.defaultParallelism)
        self.packed = kept(pack(series, params, self.chunk))
        self.worker = _Worker(params, self.chunk, self.n - params.length + 1)

    def _means(self) -> tuple[np.ndarray, np.ndarray]:
        p, worker, shift = self.params, self.worker, self.params.convolution * self.least

        def part(row: dict) -> list[dict]:
            n = worker.share(row["chunk"])
            if not n:
                return []
            conv = worker.sums(row["records"])[: n + p.width - 1]
            n, sums, cross = numeric.scatter(numeric.hankel(conv, p.width)[:n], shift)
            return [{"n": n, "sums": sums, "cross": cross.reshape(-1)}]

        rows = _mapped(self.packed, part, "n long, sums array<double>, cross array<double>")
        flat = rows.select("n", F.posexplode(F.concat("sums", "cross")).alias("at", "v")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("at").toPandas()
        n, w, total = int(flat["n"].iloc[0]), p.width, flat["v"].to_numpy()
        sums, cross = total[:w], total[w:].reshape(w, w)
        centred = cross - np.outer(sums, sums) / n
        if not np.trace(centred) > 1e-12 * max(1.0, abs(np.trace(cross))):
            raise ValueError("the series is constant: it has no principal components")
        return sums / n + shift, numeric.components(centred)

    def fit(self) -> Model:
        p = self.params
        means, pc = self._means()
        filters, offsets = trajectory_filters(means, pc, self.least, p.convolution)
        worker = self.worker

        def ends(row: dict) -> list[dict]:
            x, y = worker.plane(row["records"], worker.share(row["chunk"]), filters, offsets)
            return [{"x": np.abs(x).max(), "y": np.abs(y).max()}] if len(x) else []

        top = _mapped(self.packed, ends, "x double, y double").agg(F.max("x"), F.max("y")).first()
        extent, radius = p.scale * max(top[0], top[1]), float(np.hypot(top[0], top[1]))
        directions = np.array([d[1:] for d in ray_directions(p.segments)])

        def cross(row: dict) -> list[dict]:
            count = worker.ahead(row["chunk"])
            x, y = worker.plane(row["records"], count + 1 if count else 0, filters, offsets)
            transition, segment, distance = numeric.crossings(x, y, p.segments, radius, directions)
            return [{"chunk": row["chunk"], "count": count, "transition": transition.astype(np.int32), "segment": segment.astype(np.int32), "distance": distance}]

        self.crossed = kept(_mapped(self.packed, cross, CROSSED))
        nodes = self._nodes(extent)
        start = np.concatenate([[0], np.cumsum([max(1, len(n)) for n in nodes])])
        model = Model(p, filters, offsets, extent, radius, nodes, start)
        self._graph(model)
        return model

    def _nodes(self, extent: float) -> list[np.ndarray]:
        p, worker = self.params, self.worker
        middle = extent / 2

        def moments(row: dict) -> list[dict]:
            own = worker.own(row)
            s, d = row["segment"][own], row["distance"][own] - middle
            n = np.bincount(s, minlength=p.segments)
            return [{"n": n, "a": np.bincount(s, d, p.segments), "b": np.bincount(s, d * d, p.segments)}]

        flat = _mapped(self.crossed, moments, "n array<long>, a array<double>, b array<double>")
        flat = flat.select(F.posexplode(F.arrays_zip("n", "a", "b")).alias("s", "v")).groupBy("s").agg(F.sum("v.n").alias("n"), F.sum("v.a").alias("a"), F.sum("v.b").alias("b")).toPandas()
        flat = flat.set_index("s").reindex(range(p.segments)).fillna(0)
        n, a, b = (flat[c].to_numpy() for c in "nab")
        with np.errstate(divide="ignore", invalid="ignore"):
            variance = np.where(n > 1, (b - a * a / n) / (n - 1), 0.0)
            whitening = np.where(variance > 1e-300, n**0.2 / np.sqrt(variance), 0.0)
        points = np.arange(p.grid) * extent / p.grid

        def sums(row: dict) -> list[dict]:
            own = worker.own(row)
            s, d = row["segment"][own], row["distance"][own]
            order = np.argsort(s, kind="stable")
            s, d = s[order], d[order]
            cuts = np.searchsorted(s, np.arange(p.segments + 1))
            out = []
            for k in np.flatnonzero(whitening):
                if cuts[k] < cuts[k + 1]:
                    out.append({"s": int(k), "total": numeric.density_sums(d[cuts[k] : cuts[k + 1]], points, whitening[k])})
            return out

        rows = _mapped(self.crossed, sums, "s int, total array<double>")
        rows = rows.select("s", F.posexplode("total").alias("u", "v")).groupBy("s", "u").agg(F.sum("v").alias("v")).toPandas()
        density = np.zeros((p.segments, p.grid))
        density[rows["s"].to_numpy(), rows["u"].to_numpy()] = rows["v"].to_numpy()
        return [points[numeric.maxima(density[k] / max(n[k], 1))] for k in range(p.segments)]

    def _graph(self, model: Model) -> None:
        """Edge weights and degrees. A first pass finds each chunk's last node, which the next chunk begins from."""
        worker, size = self.worker, model.size
        sent = self.spark.sparkContext.broadcast(model)

        def ends(row: dict) -> list[dict]:
            own = worker.own(row)
            s, d = row["segment"][own], row["distance"][own]
            return [{"chunk": row["chunk"], "last": int(sent.value.number(s[-1:], d[-1:])[0])}] if len(s) else []

        self.lasts = self._carried(_mapped(self.crossed, ends, "chunk long, last long"))
        rows = self.crossed.join(self.lasts, "chunk")

        def count(row: dict) -> list[dict]:
            m, own = sent.value, worker.own(row)
            number = m.number(row["segment"][own], row["distance"][own])
            _, a, b = numeric.edge_walk(row["transition"][own].astype(np.int64), number, min(row["count"], worker.share(row["chunk"])), row["before"])
            found, n = np.unique(a * size + b, return_counts=True)
            return [{"e": found, "n": n}] if len(found) else []

        counted = _mapped(rows, count, "e array<long>, n array<long>").select(F.inline(F.arrays_zip("e", "n"))).groupBy("e").agg(F.sum("n").alias("n"))
        edges = counted.toPandas()  # at most size**2, whatever the length of the series
        model.weights = dict(zip(edges["e"].tolist(), edges["n"].tolist()))
        keys = np.array(list(model.weights), np.int64)
        model.degrees = np.bincount(keys // size, minlength=size) + np.bincount(keys % size, minlength=size) if len(keys) else np.zeros(size, np.int64)

    def _carried(self, lasts: DataFrame, before: int = -1) -> DataFrame:
        """``chunk`` and ``before``, the last node of the nearest earlier chunk that has one, or the one given; two levels, so no task gets all chunks."""
        from raywalk.operators.chunks import carried

        every = self.packed.select("chunk").join(lasts, "chunk", "left")
        return carried(every, F.col("last"), [], name="before").select("chunk", F.coalesce("before", F.lit(before)).cast("long").alias("before"))

    def path_scores(self, model: Model) -> DataFrame:
        """Chunk rows with arrays: first start position and path scores, as far as the chunk's running means need them."""
        worker, p = self.worker, self.params
        keys, summands = model.tables()
        sent = self.spark.sparkContext.broadcast((model, keys, summands))

        def score(row: dict) -> list[dict]:
            m, known, worth = sent.value
            number = m.number(row["segment"], row["distance"])
            at, a, b = numeric.edge_walk(row["transition"].astype(np.int64), number, row["count"], row["before"])
            if not len(at):
                return []
            edge = a * m.size + b
            place = np.minimum(np.searchsorted(known, edge), max(len(known) - 1, 0))
            value = np.where(known[place] == edge, worth[place], 0.0) if len(known) else np.zeros(len(edge))
            first = int(at[0])
            total, n = numeric.slot_sums(at - first, value, row["count"] - first)
            paths = worker.moving(total, p.query) / worker.moving(n, p.query)
            own = max(0, min(len(paths), worker.chunk - first))
            return [{"chunk": row["chunk"], "first": row["chunk"] * worker.chunk + first, "own": own, "score": paths[: own + p.length - 1]}]

        rows = self.crossed.join(self.lasts, "chunk")
        return _mapped(rows, score, "chunk long, first long, own int, score array<double>")

    @staticmethod
    def _ends(paths: DataFrame) -> tuple[float, float]:
        own = F.slice("score", 1, F.col("own"))
        ends = paths.where("own > 0").agg(F.min(F.array_min(own)), F.max(F.array_max(own))).first()
        return (float("nan"), float("nan")) if ends[0] is None else tuple(ends)

    def ends(self, model: Model) -> tuple[float, float]:
        """Least and greatest path score of the series."""
        return self._ends(self.path_scores(model))

    def score(self, model: Model, ends: tuple[float, float] | None = None) -> DataFrame:
        """``start_idx`` and ``anomaly_score``, higher for stranger subsequences. In no order. ``ends``: the path scores that become 1 and 0,
        by default the series' own; scores beyond ends that another series has given are under 0 or over 1."""
        p, worker = self.params, self.worker
        paths = self.path_scores(model)
        if ends is None:
            paths = kept(paths)
            ends = self._ends(paths)
        least, most = ends

        def smooth(row: dict) -> list[dict]:
            z = (most - row["score"]) / (most - least) if most > least else np.zeros(len(row["score"]))
            means = (worker.moving(z, p.length) / p.length)[: row["own"]]
            return [{"first": row["first"], "means": means}] if len(means) else []

        rows = _mapped(paths, smooth, "first long, means array<double>")
        return rows.select("first", F.posexplode("means").alias("k", "anomaly_score")).select((F.col("first") + F.col("k")).alias("start_idx"), "anomaly_score")

    def trajectory(self, model: Model) -> DataFrame:
        """``idx``, ``x``, ``y``."""
        worker = self.worker

        def points(row: dict) -> list[dict]:
            x, y = worker.plane(row["records"], worker.share(row["chunk"]), model.filters, model.offsets)
            return [{"first": row["chunk"] * worker.chunk, "x": x, "y": y}] if len(x) else []

        rows = _mapped(self.packed, points, "first long, x array<double>, y array<double>").select("first", F.posexplode(F.arrays_zip("x", "y")).alias("k", "p"))
        return rows.select((F.col("first") + F.col("k")).alias("idx"), "p.x", "p.y")

    def cross_with(self, model: Model, before: int = -1) -> None:
        """Take crossings and carried nodes of this series from a model that another series has made. ``before``: number of the last
        node ahead of the series, or -1."""
        p, worker = self.params, self.worker
        directions = np.array([d[1:] for d in ray_directions(p.segments)])
        sent = self.spark.sparkContext.broadcast(model)

        def cross(row: dict) -> list[dict]:
            m, count = sent.value, worker.ahead(row["chunk"])
            x, y = worker.plane(row["records"], count + 1 if count else 0, m.filters, m.offsets)
            far = max(m.radius, float(np.hypot(x, y).max()) if len(x) else 0.0)
            transition, segment, distance = numeric.crossings(x, y, p.segments, far, directions)
            return [{"chunk": row["chunk"], "count": count, "transition": transition.astype(np.int32), "segment": segment.astype(np.int32), "distance": distance}]

        self.crossed = kept(_mapped(self.packed, cross, CROSSED))

        def ends(row: dict) -> list[dict]:
            own = worker.own(row)
            s, d = row["segment"][own], row["distance"][own]
            return [{"chunk": row["chunk"], "last": int(sent.value.number(s[-1:], d[-1:])[0])}] if len(s) else []

        self.lasts = self._carried(_mapped(self.crossed, ends, "chunk long, last long"), before)

    def last_node(self, model: Model, end: int, before: int = -1) -> int:
        """Number of the last node on the transitions under ``end``, or ``before`` if there is none."""
        worker, sent = self.worker, self.spark.sparkContext.broadcast(model)

        def last(row: dict) -> list[dict]:
            own = np.flatnonzero((row["transition"] < worker.chunk) & (row["transition"] + row["chunk"] * worker.chunk < end))[-1:]
            return [{"chunk": row["chunk"], "last": int(sent.value.number(row["segment"][own], row["distance"][own])[0])}] if len(own) else []

        found = _mapped(self.crossed, last, "chunk long, last long").agg(F.max_by("last", "chunk")).first()[0]
        return before if found is None else found


@dataclass(frozen=True)
class _Worker:
    """The part of a detector that tasks need."""

    params: Params
    chunk: int
    rows: int

    def sums(self, records: np.ndarray) -> np.ndarray:
        return (numeric.frame_sums if self.params.naive else numeric.sliding_sums)(records, self.params.convolution)

    def moving(self, values: np.ndarray, length: int) -> np.ndarray:
        return (numeric.frame_sums if self.params.naive else numeric.moving)(values, length)

    def share(self, at: int) -> int:
        return max(0, min(self.chunk, self.rows - at * self.chunk))

    def ahead(self, at: int) -> int:
        return max(0, min(self.chunk + self.params.query + self.params.length, self.rows - 1 - at * self.chunk))

    def own(self, row: dict) -> np.ndarray:
        """Crossings of the chunk's own transitions."""
        return np.flatnonzero(row["transition"] < self.chunk)

    def plane(self, records: np.ndarray, count: int, filters: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ``count`` points: sliding dot products of the sums with the two filters, centred first."""
        p = self.params
        conv = self.sums(records)[: count + p.width - 1] if count else np.zeros(0)
        if len(conv) < p.width:
            return np.zeros(0), np.zeros(0)
        middle = conv.mean()
        shift = middle * filters.sum(axis=0) - offsets
        x, y = (np.correlate(conv - middle, filters[:, k], "valid") + shift[k] for k in (0, 1))
        return x, y


def detect(series: DataFrame, params: Params = Params()) -> DataFrame:
    """Fit on a series and score it: ``start_idx``, ``anomaly_score``."""
    detector = Detector(series, params)
    return detector.score(detector.fit())


def score_with(model: Model, series: DataFrame, ends: tuple[float, float] | None = None) -> DataFrame:
    """Score another series with a model that is fitted already; edges that the model doesn't know weigh nothing."""
    detector = Detector(series, model.params)
    detector.cross_with(model)
    return detector.score(model, ends)
