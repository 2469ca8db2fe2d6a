"""Near-duplicate documents: MinHash banding, verification, connected components.

A document's set is its distinct shingles of ``words`` lower-cased words. Documents whose sets
have at least the threshold of their union in common are linked; components of links are found by
alternating large-star and small-star. In detail:

1. One pass hashes every whole text: set size, a 128-bit fingerprint of the set, band keys over many
   universal hash minima, and a byte of each minimum as signature. Equal sets fall together by
   fingerprint; only the least id of each class goes on.
2. In each band bucket every class is paired with the bucket's pivot (its least id). Signatures drop
   pairs that can't be links; the rest is confirmed on full sets.
3. What a bucket still leaves open is checked in blocks: classes that were neither confirmed with
   the pivot nor are already of its component, against each other and, where the triangle inequality
   of the Jaccard distance allows a link, against the confirmed ones. No bucket is collected in one task:
   buckets of over ``block`` open classes, or ``block_bytes`` of shingles, are dealt to pairs of blocks. Signatures go first; whole
   sets follow only of classes that they leave a possible partner in the same pair of blocks.

A pair of exactly the threshold shares no band with probability (1 - t**rows)**bands, under 1e-5 for
the defaults at 0.8.

Defined results: null, empty or blank text has no set, is linked with nothing and, if its key has no other text, is its own component; a text
of fewer words than a shingle is one shingle as a whole; a null key is linked with nothing, has a
null component and is kept; rows that repeat a key each get a row, and a key with several texts is one document that
has the links of all of them; very long texts are hashed whole; an empty table gives no rows; only the key of the input is returned, so
other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raywalk.llm import shared
from raywalk.llm.components import components
from raywalk.llm.text import buffers, mix, windows, word_hashes

#: Ids that may be sent to all executors at once: 16 MB.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Params:
    """Shingle size, threshold in percent, bands and rows (their product is the number of minima), classes and bytes of sets of a block."""

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    block: int = 2048
    block_bytes: int = 16 << 20

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        """Signature agreement that a link goes below with a probability of under 1e-11."""
        t = self.percent / 100
        return max(0.0, t - 7 * float(np.sqrt(t * (1 - t) / self.hashes)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document."""
    for i, j in windows(offsets):
        at = offsets[i : j + 1] - offsets[i]
        words, of = word_hashes(data[offsets[i] : offsets[j]], at)
        n = len(words)
        whole = np.zeros(max(0, n - k + 1), np.uint64)
        for x in range(k if n >= k else 0):
            whole = whole * np.uint64(0x9E3779B97F4A7C15) + words[x : n - k + 1 + x]
        whole = mix(whole)
        for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
            if b - a >= k:
                yield np.unique(whole[a : b - k + 1])
            elif b > a:
                h = np.uint64(b - a)
                for w in words[a:b]:
                    h = mix(np.array([h]) * np.uint64(0xC2B2AE3D27D4EB4F) + w)[0]
                yield np.array([h], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _minima(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each universal hash (a * x + b modulo 2**64, upper half) over a set."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        h = a[:, None] * found[None, i : i + 512]
        h += b[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out >> np.uint64(32)


def _prints(df: DataFrame, text: str, key: str, p: Params) -> DataFrame:
    """``id``, ``n``, fingerprint ``f1`` ``f2``, ``sig`` and ``bands`` of each row."""
    rng = np.random.default_rng(20240517)
    a = rng.integers(0, 1 << 63, p.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, p.hashes, dtype=np.uint64)
    weights = rng.integers(0, 1 << 63, p.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, f1, f2, sigs, bands = [], [], [], [], []
            for found in shingle_sets(*buffers(batch.column("text")), p.words):
                sizes.append(len(found))
                f1.append(np.add.reduce(mix(found)))
                f2.append(np.add.reduce(mix(found * np.uint64(0xC2B2AE3D27D4EB4F))))
                if len(found):
                    m = _minima(found, a, b)
                    sigs.append((mix(m) & np.uint64(255)).astype(np.uint8).tobytes())
                    keys = mix(m.reshape(p.bands, p.rows) @ weights + np.arange(p.bands, dtype=np.uint64))
                    bands.append(keys.view(np.int64))
                else:
                    sigs.append(b"")
                    bands.append(np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "f1", "f2", "sig", "bands"])

    schema = T.StructType([
        T.StructField("id", df.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()),
        T.StructField("f2", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])
    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _agreement(a: pa.Array, b: pa.Array, width: int) -> np.ndarray:
    """Share of equal minima of each pair of signatures, freed of chance agreement of one byte."""
    x, _ = buffers(a)
    y, _ = buffers(b)
    same = (x.reshape(-1, width) == y.reshape(-1, width)).mean(axis=1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _estimated(pairs: DataFrame, reps: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) with ``est``, the agreement of their signatures."""
    kind = reps.schema["id"].dataType
    sides = pairs.join(reps.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b").join(reps.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            est = _agreement(batch.column("sig_a"), batch.column("sig_b"), p.hashes)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est.astype(np.float32))], ["a", "b", "est"])

    return sides.select("a", "b", "sig_a", "sig_b").mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("est", T.FloatType())]))


def _sets(df: DataFrame, ids: DataFrame, text: str, key: str, p: Params) -> DataFrame:
    """``id`` and ``shingles`` (64-bit hashes, sorted) of the wanted ids, from whole texts."""
    kind = df.schema[key].dataType
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(*buffers(batch.column("text")), p.words)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "shingles"])

    return rows.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("shingles", T.BinaryType())]))


def _confirmed(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) with ``linked``, decided on full sets."""
    kind = sets.schema["id"].dataType
    sides = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                out[k] = _linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), p.percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], ["a", "b", "linked"])

    return sides.select("a", "b", "set_a", "set_b").mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("linked", T.BooleanType())]))


def _in_blocks(df: DataFrame, members: DataFrame, tested: DataFrame, comps: DataFrame, reps: DataFrame, text: str, key: str, p: Params) -> DataFrame:
    """Links (a, b) between components that the pivots' tests don't settle: open classes that share a bucket meet
    in pairs of blocks, with signatures and full sets; a block pair gives a spanning forest of its links.
    ``members``: key, band, id, pivot; ``tested``: a (the pivot), b, est, linked."""
    t = p.percent / 100
    near = max(0.0, 2 * t - 1)
    near -= 7 * float(np.sqrt(max(near * (1 - near), 0.01) / p.hashes))
    own = comps.select(F.col("node").alias("id"), F.col("component").alias("comp"))
    found = tested.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "est", "linked").join(own, "id", "left")
    # 0: confirmed with the pivot, 1: near enough to have a link to such a one, 2: far
    found = found.select("pivot", "id", F.coalesce("comp", "id").alias("comp"), F.when(F.col("linked"), 0).when(F.col("est") >= near, 1).otherwise(2).alias("kind"))
    rows = members.join(found.join(reps.select("id", "n"), "id"), ["pivot", "id"])
    opened, middle = F.when(F.col("kind") > 0, F.col("comp")), F.when(F.col("kind") == 1, F.col("comp"))
    buckets = rows.groupBy("key").agg(
        F.count(opened).alias("n_open"), F.count("*").alias("n_all"), F.min(opened).alias("open_a"), F.max(opened).alias("open_b"),
        F.min(middle).alias("near_a"), F.max(middle).alias("near_b"), F.min(F.when(F.col("kind") == 0, F.col("comp"))).alias("pivot_comp"),
        F.sum(F.when(F.col("kind") > 0, F.col("n"))).alias("size_open"), F.sum("n").alias("size_all"),
    )
    # confirmed classes matter where one that is near isn't of their component, which is the pivot's
    core = F.coalesce((F.col("near_a") != F.col("pivot_comp")) | (F.col("near_b") != F.col("pivot_comp")), F.lit(False))
    buckets = buckets.withColumn("core", core).where("core OR open_a != open_b")
    parts = lambda n, size: F.greatest(F.ceil(F.col(n) / p.block), F.ceil(F.col(size) * 8 / p.block_bytes)).cast("long")
    made = F.struct("core", F.when(F.col("core"), parts("n_all", "size_all")).otherwise(parts("n_open", "size_open")).alias("m"))
    buckets = buckets.select("key", made.alias("made"), F.col("n_all").alias("rows"))
    rows = shared.with_value(rows, buckets, "key", "made", members.count()).where("made IS NOT NULL").select("*", "made.core", "made.m")
    rows = shared.write_table(rows.where("core OR kind > 0").select("key", "band", "id", "comp", "kind", "m", "n"), "open")
    # each row once for every pair of blocks that its own is in
    marks = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("m"))).join(reps.select("id", "sig", "bands"), "id")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("other")
    met = marks.select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    member = F.struct("id", "comp", "kind", "block", "n", "sig", "bands")
    groups = met.groupBy("key", "band", "i", "j").agg(F.collect_list(member).alias("g")).where(F.size("g") > 1)
    kind, of = reps.schema["id"].dataType, T.StructType([T.StructField(c, T.LongType()) for c in ("key", "i", "j")] + [T.StructField("band", T.IntegerType())])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.schema.field("g").type.value_type.field("id").type
            for k in range(batch.num_rows):
                at = {c: batch.column(c)[k].as_py() for c in ("key", "i", "j", "band")}
                g = sorted(batch.column("g")[k].as_py(), key=lambda r: r["id"])
                keep = _possible(g, at["band"], at["i"] == at["j"], p)
                left = [r for r, x in zip(g, keep.tolist()) if x]
                if left:
                    same = lambda v, t: pa.array([v] * len(left), t)
                    yield pa.RecordBatch.from_arrays([same(at["key"], pa.int64()), same(at["i"], pa.int64()), same(at["j"], pa.int64()), same(at["band"], pa.int32()), pa.array([r["id"] for r in left], ids)], ["key", "i", "j", "band", "id"])

    left = shared.write_table(groups.select("key", "i", "j", "band", "g").mapInArrow(likely, T.StructType([*of.fields, T.StructField("id", kind)])), "left")
    ids = shared.write_table(left.select("id").distinct(), "ids")
    whole = left.join(marks, ["key", "band", "id"]).join(_sets(df, ids, text, key, p), "id")
    groups = whole.groupBy("key", "band", "i", "j").agg(F.collect_list(F.struct("id", "comp", "kind", "block", "n", "sig", "bands", "shingles")).alias("g")).select("band", "i", "j", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.schema.field("g").type.value_type.field("id").type
            for k in range(batch.num_rows):
                g = sorted(batch.column("g")[k].as_py(), key=lambda r: r["id"])
                links = _block_links(g, batch.column("band")[k].as_py(), batch.column("i")[k].as_py() == batch.column("j")[k].as_py(), p)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], ids), pa.array([y for _, y in links], ids)], ["a", "b"])

    found = shared.write_table(groups.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])), "rest")
    for used in (rows, left, ids):
        shared.drop_table(used)
    return found


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _pairs(g: list[dict], band: int, alone: bool, p: Params, comp: np.ndarray, done: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each class of a block, or of two, those after it that it may have a link to, by falling agreement: pairs of different components, that
    share this band as their first, of fitting sizes and signatures, of which not both are ``done``. ``comp`` and ``done`` may change meanwhile."""
    sig = np.frombuffer(b"".join(r["sig"] for r in g), np.uint8).reshape(len(g), -1)
    bands, kinds, block, size = (np.array([r[c] for r in g]) for c in ("bands", "kind", "block", "n"))
    for x in range(len(g) - 1):
        rest = np.arange(x + 1, len(g))
        both = kinds[rest] + kinds[x]  # 0: both confirmed with the pivot, 2 of 0 and 2: too far apart
        fit = (comp[rest] != comp[x]) & (both > 0) & ((both != 2) | (kinds[rest] == kinds[x]))
        fit &= 100 * np.minimum(size[rest], size[x]) >= p.percent * np.maximum(size[rest], size[x])
        if not alone:
            fit &= block[rest] != block[x]
        if done[x]:
            fit &= ~done[rest]
        rest = rest[fit]
        if not len(rest):
            continue
        rest = rest[(bands[rest] == bands[x]).argmax(axis=1) == band]
        if len(rest):
            est = ((sig[rest] == sig[x]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            order = np.argsort(-est, kind="stable")
            yield x, rest[order][: int((est >= p.least_estimate).sum())]


def _possible(g: list[dict], band: int, alone: bool, p: Params) -> np.ndarray:
    """Classes with a possible partner."""
    comp = np.unique([r["comp"] for r in g], return_inverse=True)[1]
    keep = np.zeros(len(g), bool)
    for x, rest in _pairs(g, band, alone, p, comp, keep):
        keep[rest] = True
        keep[x] |= len(rest) > 0
    return keep


def _block_links(g: list[dict], band: int, alone: bool, p: Params) -> list[tuple]:
    """A spanning forest of the links between components in a block, or between two blocks: a pair is tested only while
    its two sides aren't known to be connected."""
    comp = np.unique([r["comp"] for r in g], return_inverse=True)[1]
    sets: dict[int, np.ndarray] = {}
    out = []
    for x, rest in _pairs(g, band, alone, p, comp, np.zeros(len(g), bool)):
        for y in rest.tolist():
            if comp[y] == comp[x]:
                continue
            for k in (x, y):
                if k not in sets:
                    sets[k] = np.frombuffer(g[k]["shingles"], np.uint64)
            if _linked(sets[x], sets[y], p.percent):
                comp[comp == comp[y]] = comp[x]
                out.append((g[x]["id"], g[y]["id"]))
    return out


def link(df: DataFrame, text: str = "text", key: str = "doc_id", params: Params = Params()) -> DataFrame:
    """One row per row of ``df``: the key, ``n_shingles``, ``component_id`` (least key reachable) and ``kept``."""
    p = params
    shared.bounded_batches(df.sparkSession)
    prints = shared.write_table(_prints(df, text, key, p), "prints")
    classes = prints.where("n > 0 AND id IS NOT NULL").groupBy("f1", "f2").agg(F.min(F.struct("id", "n", "sig", "bands")).alias("r"))
    reps = shared.write_table(classes.select("f1", "f2", "r.*"), "classes")
    bands = reps.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.count("*").alias("rows")).where("pivot != last").drop("last")
    members = shared.write_table(shared.with_value(bands, buckets, "key", "pivot", reps.count() * p.bands).where("id != pivot"), "members")
    star = members.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    estimated = shared.write_table(_estimated(star, reps, p), "estimated")
    likely = estimated.where(F.col("est") >= p.least_estimate).select("a", "b")
    ids = shared.write_table(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), "ids")
    sets = shared.write_table(_sets(df, ids, text, key, p), "sets")
    links = shared.write_table(_confirmed(likely, sets, p).where("linked"), "links")
    shared.drop_table(sets)
    comps = components(links)
    tested = estimated.join(links, ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    rest = _in_blocks(df, members, tested, comps, reps, text, key, p)
    prints_of = prints.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("f1", "f2")).alias("least"), F.max(F.struct("f1", "f2")).alias("most"))
    several = shared.write_table(prints_of.where("least != most").select("id"), "several")
    repeated = not several.isEmpty()
    if repeated:  # a key's several classes are linked by the key as a node
        texts = prints.where("n > 0").select("id", "f1", "f2").distinct().join(several, "id")
        more = rest.union(texts.join(reps.select("f1", "f2", F.col("id").alias("rep")), ["f1", "f2"]).select("id", "rep"))
    else:
        more = rest
    if repeated or not rest.isEmpty():
        comps = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    for used in (members, estimated, rest, several):
        shared.drop_table(used)
    named = reps.select("f1", "f2", F.col("id").alias("rep")).join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    some = prints.where("n > 0").select("id", "n", "f1", "f2").join(named, ["f1", "f2"], "left").select("id", "n", "component")
    none = prints.where("n = 0").select("id", "n")
    if repeated:
        none = none.join(comps.withColumnRenamed("node", "id"), "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    else:
        none = none.withColumn("component", F.col("id"))
    whole = some.unionByName(none).withColumn("component", F.when(F.col("id").isNotNull(), F.col("component")))
    return whole.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
