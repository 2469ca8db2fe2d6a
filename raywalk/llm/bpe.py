"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash over the vocabulary resolves a pre-token that is a
vocabulary entry as a whole; any other pre-token is merged, lowest rank first, with a
heap of candidate pairs over a linked list of its bytes. Both give what rank-ordered
merging gives, as a vocabulary entry is by construction its own merge result in the
vocabularies this is meant for (tiktoken looks it up first, too).

Defined results: null text counts as empty and has no ids; decoding null or empty ids
gives empty bytes; ids outside the vocabulary raise ``ValueError``; texts are encoded
whole, whatever their length; repeated rows and extra columns pass through unchanged,
and an input column that has the name of an output column is replaced by it.
"""

from __future__ import annotations

import base64
import gc
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raywalk.llm import shared
from raywalk.llm.text import mix

#: Distinct pre-tokens whose ids a Python worker remembers before it begins anew; those of the time before are still known, once.
MEMO = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file: a line has a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _fingerprints(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each key, taken from its bytes by Horner's rule, all keys together."""
    n = len(keys)
    size = np.fromiter(map(len, keys), np.int64, n)
    flat = np.frombuffer(b"".join(keys), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    out = np.empty((2, n), np.uint64)
    for k, base in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
        h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        live = np.arange(n)
        for j in range(int(size.max()) if n else 0):
            live = live[size[live] > j]
            h[live] = (h[live] ^ flat[at[live] + j]) * np.uint64(base)
            h[live] ^= h[live] >> np.uint64(29)
        out[k] = mix(h)
    return out


class PerfectHash:
    """Minimal perfect hash by displacement: keys fall into buckets, and each bucket, largest
    first, gets the first seed that sends all its keys to free slots of a table of exactly n.
    A bucket of one key names its slot instead."""

    LOAD = 3
    #: Seeds that are tried at once.
    TRIED = 32

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, -(-self.n // self.LOAD))
        self.seeds = np.zeros(self.buckets, np.int64)
        first, second = _fingerprints(keys)
        if len({*zip(first.tolist(), second.tolist())}) < self.n:
            raise ValueError("two keys are equal")
        bucket = (first % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.searchsorted(bucket[order], np.arange(1, self.buckets)))
        free = np.ones(self.n, bool)
        for g in sorted(groups, key=len, reverse=True):
            if len(g) < 2:
                break
            start, f, s = 0, first[g], second[g]
            while True:
                seeds = np.arange(start, start + self.TRIED)
                slot = np.sort(self._slots(f, s, seeds[:, None]), axis=1)
                fits = np.flatnonzero(free[slot].all(axis=1) & (slot[:, 1:] != slot[:, :-1]).all(axis=1))
                if len(fits):
                    break
                start += self.TRIED
            free[slot[fits[0]]] = False
            self.seeds[bucket[g[0]]] = seeds[fits[0]]
        single = [bucket[g[0]] for g in groups if len(g) == 1]
        self.seeds[single] = -1 - np.flatnonzero(free)

    def _slots(self, first: np.ndarray, second: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        hashed = (mix(second + seeds.astype(np.uint64) * (first | np.uint64(1))) % np.uint64(self.n)).astype(np.int64)
        return np.where(seeds < 0, -1 - seeds, hashed)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """A slot in 0..n-1 for each key; a key outside the set gets some slot, too."""
        if not keys or not self.n:
            return np.zeros(len(keys), np.int64)
        first, second = _fingerprints(keys)
        return self._slots(first, second, self.seeds[(first % np.uint64(self.buckets)).astype(np.int64)])


class Codec:
    """Encoder and decoder of one vocabulary; made once in each Python worker."""

    #: Characters of text whose pre-tokens are held at once; a longer text is held alone.
    CHARS = 1 << 18
    _made: dict[tuple[str, str], Codec] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.entry: list[bytes] = [b""] * len(tokens)
        self.entry_id = array("i", bytes(4 * len(tokens)))
        for t, slot in zip(tokens, self.hash.slots(tokens).tolist()):
            self.entry[slot], self.entry_id[slot] = t, ranks[t]
        self.byte = [ranks.get(bytes((b,))) for b in range(256)]
        self.first = [ranks.get(bytes((x, y)), -1) for x in range(256) for y in range(256)]
        self.pairs: dict[int, int] = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None:
                    self.pairs[a << 32 | b] = r
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(load_ranks(path), pattern)
        return cls._made[path, pattern]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the pair of least rank, leftmost first, is joined until none is in the vocabulary."""
        pair, first, n, push, pop = self.pairs.get, self.first, len(piece), heapq.heappush, heapq.heappop
        ids = [self.byte[b] for b in piece]
        if None in ids:
            raise ValueError("a byte isn't in the vocabulary")
        # what the pair that begins at each place makes, or -1; the heap's entries hold as long as they agree with it
        makes = [first[x << 8 | y] for x, y in zip(piece, piece[1:])]
        heap = [r << 32 | i for i, r in enumerate(makes) if r >= 0]
        if not heap:
            return ids
        makes.append(-1)
        heapq.heapify(heap)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if makes[i] != r:
                continue
            j = right[i]
            ids[i], ids[j], makes[j] = r, -1, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                x = makes[i] = pair(r << 32 | ids[k], -1)
                if x >= 0:
                    push(heap, x << 32 | i)
            else:
                makes[i] = -1
            h = left[i]
            if h >= 0:
                x = makes[h] = pair(ids[h] << 32 | r, -1)
                if x >= 0:
                    push(heap, x << 32 | h)
        return [x for x in ids if x >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pre-tokens, as bytes of int32."""
        memo, older = self.memo, self.older
        new = []
        for p in pieces:
            if p in older:
                memo[p] = older[p]
            else:
                new.append(p)
        raw = [p.encode() for p in new]
        entry, ids, merge = self.entry, self.entry_id, self.merge
        for p, b, slot in zip(new, raw, self.hash.slots(raw).tolist()):
            if entry and entry[slot] == b:
                memo[p] = ids[slot : slot + 1].tobytes()
            else:
                memo[p] = array("i", merge(b)).tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, as bytes of int32; new pre-tokens of many texts are learned together."""
        i = 0
        while i < len(texts):
            j, size, splits = i, 0, []
            while j < len(texts) and (j == i or size + len(texts[j] or "") <= self.CHARS):
                splits.append(self.split(texts[j] or ""))
                size += len(texts[j] or "")
                j += 1
            distinct = set().union(*splits)
            if len(self.memo) > MEMO:
                self.memo, self.older = {}, self.memo
            self.learn(distinct.difference(self.memo))
            for pieces in splits:
                yield b"".join(map(self.memo.__getitem__, pieces))
            i = j


class Decoder:
    """Bytes of each id of one vocabulary; all that decoding needs."""

    #: Ids that are looked up at once.
    SLICE = 1 << 15
    _made: dict[str, Decoder] = {}

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values(), default=-1)
        self.tokens: list[bytes] = [b""] * (top + 1)
        self.known = np.zeros(top + 1, bool)
        for t, r in ranks.items():
            self.tokens[r], self.known[r] = t, True
        self.size = np.fromiter(map(len, self.tokens), np.int64, top + 1)

    @classmethod
    def of(cls, path: str) -> Decoder:
        if path not in cls._made:
            cls._made[path] = cls(load_ranks(path))
        return cls._made[path]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id isn't in the vocabulary")
        token = self.tokens.__getitem__
        return b"".join([b"".join(map(token, ids[i : i + self.SLICE].tolist())) for i in range(0, len(ids), self.SLICE)])

    def column(self, values: np.ndarray, counts: np.ndarray) -> pa.Array:
        """One binary value for each of the runs of ids."""
        data = self.decode(values)
        sizes = np.concatenate([[0], np.cumsum(self.size[values])])
        ends = sizes[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = batch.schema.names
    if name in names:
        return batch.set_column(names.index(name), name, column)
    return batch.append_column(name, column)


def _schema(df: DataFrame, **made: T.DataType) -> T.StructType:
    fields = [T.StructField(f.name, made.get(f.name, f.dataType), True) for f in df.schema.fields]
    return T.StructType([*fields, *(T.StructField(n, k, True) for n, k in made.items() if n not in df.columns)])


def _encoded(codec: Codec, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The column of ids, all ids together, and the number of ids of each text."""
    collecting = gc.isenabled()
    gc.disable()  # encoding makes very many lists and no cycles
    try:
        parts = list(codec.encode(texts.to_pylist()))
    finally:
        if collecting:
            gc.enable()
    counts = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
    data = b"".join(parts)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(data)])
    return pa.ListArray.from_arrays(pa.array(ends), ids), np.frombuffer(data, np.int32), counts


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the ids of the whole ``text``: array<int>. ``path`` must be readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            yield _with(batch, out, _encoded(codec, batch.column(text))[0])

    shared.bounded_batches(df.sparkSession)
    return df.mapInArrow(run, _schema(df, **{out: T.ArrayType(T.IntegerType())}))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes that the ``ids`` stand for: binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder.of(path)
        for batch in batches:
            column = batch.column(ids)
            flat = column.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            counts = np.fromiter((x or 0 for x in column.value_lengths().to_pylist()), np.int64, len(column))
            yield _with(batch, out, decoder.column(flat.to_numpy(zero_copy_only=False), counts))

    shared.bounded_batches(df.sparkSession)
    return df.mapInArrow(run, _schema(df, **{out: T.BinaryType()}))


def transcode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` of the ids in one pass, so that they aren't sent through Spark in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, decoder = Codec.of(path, pattern), Decoder.of(path)
        for batch in batches:
            column, values, counts = _encoded(codec, batch.column(text))
            yield _with(_with(batch, ids, column), out, decoder.column(values, counts))

    shared.bounded_batches(df.sparkSession)
    return df.mapInArrow(run, _schema(df, **{ids: T.ArrayType(T.IntegerType()), out: T.BinaryType()}))


def digests(df: DataFrame, key: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Counts and digests of ids and decoded bytes; a null counts as empty."""
    return df.select(
        key,
        F.coalesce(F.size(ids), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.coalesce(F.array_join(F.col(ids).cast("array<string>"), ","), F.lit("")), 256).alias("ids_sha256"),
        F.sha2(F.coalesce(decoded, F.lit("").cast("binary")), 256).alias("decoded_sha256"),
    )
