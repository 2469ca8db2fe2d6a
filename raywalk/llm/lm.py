"""Language-model scoring: a log-bilinear neural model over smoothed word counts.

Tokens are lower-cased words, then one end mark. Every token has a class: the commonest words and the end mark one of their
own, other common words by frequency, all other words by length. A token's probability is that of its class after the two
tokens before it, times that of the word inside its class after the token before it; both are log-bilinear:

* The vectors of the two context classes, each under a matrix for its place, add up to a predicted vector, whose products
  with the class vectors are scores.
* Every word that occurs MIN_COUNT times has a target vector of its own, whose product with the context's vector shifts its
  add-one share of the class. Words with fewer occurrences, and the unseen ones, for which each rare class leaves one share, have
  none: their shift is 0.

Both are trained in numpy by noise-contrastive estimation on counts of the whole training corpus, against NOISE noise tokens that are drawn for each
token from the distribution of classes, or of the words of the class. As contexts are few, all counts of a context are worked on together. Batched matrix
products give the scores of all classes in all contexts, and of all words of a class after all tokens, from
which both parts are normalised exactly.

Counts cover all training rows and stay distributed, and so do the words with their vectors, whose number grows with the corpus; the
driver gets the HEAD commonest words with theirs, class counts (at most CLASSES**3) and sums by class. Rare words get
their counts and vectors by a join.

Defined results: null and empty texts have the end mark as only token; with no training rows N and V are 0, the base
score is 0 and every class is equally likely; a null key stays null; repeated rows are scored each for
itself; very long texts are walked whole; an empty table gives no rows; other columns aren't returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raywalk.llm import shared
from raywalk.llm.text import buffers, mix, span_hashes, spans, windows

#: Words whose counts are sent to all executors: 1.5 MB. Words that occur once are never among them: they stand for the unseen.
HEAD = 65_536
OWN, BY_RANK, BY_LENGTH = 95, 16, 16
CLASSES = 1 + OWN + BY_RANK + BY_LENGTH
END = 0
#: The bits of a word's hash that a class takes in counts by word and class; the other 57 name the word there.
_LAST = np.uint64(127)
DIMENSIONS, NOISE, ROUNDS, RATE = 24, 8, 100, 0.03
#: Rounds after which the noise of classes is drawn anew.
REDRAW = 10
#: Occurrences from which on a word has a vector of its own, the weight of its squared length, and Newton's steps.
MIN_COUNT, RIDGE, STEPS = 4, 40.0, 6
#: Tokens by the overall distribution that each context is thought to have had besides its own, and the weight of squared parameters against tokens.
PRIOR, DECAY = 1.0, 20.0


class Words:
    """Lookup of 64-bit word hashes in a sorted table, by buckets of their upper bits."""

    SHIFT = np.uint64(46)

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.append(hashes, np.uint64((1 << 64) - 1))
        self.start = np.searchsorted(hashes, np.arange(1 << 18, dtype=np.uint64) << self.SHIFT)
        ends = np.append(self.start[1:], len(hashes))
        self.deepest = int((ends - self.start).max()) if len(hashes) else 0
        self.n = len(hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the table, or -1."""
        at = self.start[(hashes >> self.SHIFT).astype(np.int64)]
        out = np.full(len(hashes), -1, np.int64)
        for _ in range(self.deepest):
            hit = self.sorted[at] == hashes
            out[hit] = at[hit]
            at = np.minimum(at + 1, self.n)
        out[out >= self.n] = -1
        return out


@dataclass
class Head:
    """The commonest words: their hashes in order, counts and classes."""

    words: Words
    counts: np.ndarray
    classes: np.ndarray

    def classify(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head (or -1) and class of each word."""
        place = self.words.find(hashes)
        rare = 1 + OWN + BY_RANK + np.minimum(lengths, BY_LENGTH) - 1
        return place, np.where(place >= 0, np.append(self.classes, 0)[place], rare)


@dataclass
class Model:
    head: Head
    tokens: int  # N
    distinct: int  # V
    ends: int  # count of the end mark
    mass: np.ndarray  # of each class: sum of count + 1, and 1 for unseen words of rare ones
    table: np.ndarray  # log10 probability of each class, by context
    after: np.ndarray  # vector of each class as the last of a context
    targets: np.ndarray  # vector of each word of the head
    shift: np.ndarray  # what the words' vectors add to the mass of each class (row) after each class
    rare: DataFrame | None = None  # w, n, u: counts of all words, and what the rest's vectors add after each class

    @property
    def floor(self) -> float:
        return float(np.log10(self.tokens + self.distinct + 1))


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, of = spans(data, offsets)
    return span_hashes(data, starts, ends), ends - starts, of


def _count_words(df: DataFrame) -> DataFrame:
    """``w``, ``size`` (capped length) and ``n`` of every word of column ``text``, a row for each word and task before the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            w, s, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(w, kind="stable")
            w, s, n = w[order], s[order], n[order]
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            return w[first], s[first], np.add.reduceat(n, first)

        def out(part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(part[0]), 100_000):
                w, s, n = (x[i : i + 100_000] for x in part)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n)], ["w", "size", "n"])

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in windows(offsets, 4 << 20):
                w, lengths, _ = _hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if not len(w):
                    continue
                order = np.argsort(w)
                w, lengths = w[order], np.minimum(lengths[order], BY_LENGTH)
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                held.append((w[first], lengths[first], np.diff(np.append(first, len(w)))))
                size += len(first)
            if size > 2_000_000:
                part = merged()
                if len(part[0]) > 1_500_000:
                    yield from out(part)
                    held, size = [], 0
                else:
                    held, size = [part], len(part[0])
        if held:
            yield from out(merged())

    return df.mapInArrow(run, "w long, size int, n long").groupBy("w").agg(F.max("size").alias("size"), F.sum("n").alias("n"))


def _count_contexts(df: DataFrame, head: Head) -> DataFrame:
    """Counts over all tokens of column ``text``: of (class before the last, last class, class), as ``w`` = their number with ``c`` = -1, and of
    (word, last class) for words without a class of their own, as ``w`` and ``c``."""
    sent = df.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(k, kind="stable")
            k, n = k[order], n[order]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            return k[first], np.add.reduceat(n, first)

        def out(w: np.ndarray, c: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(w), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(w[part]), pa.array(c[part].astype(np.int32)), pa.array(n[part])], ["w", "c", "n"])

        def words() -> Iterator[pa.RecordBatch]:
            k, n = merged()
            yield from out((k & ~_LAST).view(np.int64), (k & _LAST).astype(np.int32), n)

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in windows(offsets, 4 << 20):
                classes, contexts, (hashes, _, _), at = _walk(sent.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                total += np.bincount(contexts * CLASSES + classes, minlength=CLASSES**3)
                inside = np.ones(len(classes), bool)
                inside[at[1:] - 1] = False
                shared_class = classes[inside] > OWN
                if shared_class.any():
                    k = np.sort((hashes[shared_class] & ~_LAST) | (contexts[inside][shared_class] % CLASSES).astype(np.uint64))
                    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                    held.append((k[first], np.diff(np.append(first, len(k)))))
                    size += len(first)
            if size > 3_000_000:
                part = merged()
                if len(part[0]) > 2_000_000:
                    held = [part]
                    yield from words()
                    held, size = [], 0
                else:
                    held, size = [part], len(part[0])
        if held:
            yield from words()
        some = np.flatnonzero(total)
        yield from out(some, np.full(len(some), -1), total[some])

    return df.mapInArrow(run, "w long, c int, n long").groupBy("w", "c").agg(F.sum("n").alias("n"))


def _class_counts(contexts: DataFrame) -> np.ndarray:
    """CLASSES**2 x CLASSES."""
    rows = contexts.where("c = -1").select("w", "n").toArrow()
    out = np.zeros(CLASSES**3)
    out[rows["w"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(CLASSES**2, CLASSES)


def _walk(head: Head, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple, np.ndarray]:
    """Class and context of every token of some documents, end marks included; (hashes, places) of the words; tokens' offsets."""
    hashes, lengths, of = _hashed(data, offsets)
    place, own = head.classify(hashes, lengths)
    docs = len(offsets) - 1
    at = of + np.arange(docs + 1)
    classes = np.full(at[-1], END, np.int64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    classes[inside] = own
    # before a document's first token there are two end marks: the last token of the previous document is one, too
    one, two = np.full(at[-1], END), np.full(at[-1], END)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    two[at[:-1]] = END
    second = at[:-1] + 1
    two[second[second < at[1:]]] = END
    return classes, two * CLASSES + one, (hashes, place, of), at


def train(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities of the classes in each context, and the vector of each class as the last of a context: a log-bilinear
    model fitted by noise-contrastive estimation."""
    k, d = CLASSES, DIMENSIONS
    unigram = counts.sum(axis=0) + 1
    noise = unigram / unigram.sum()
    seen = np.flatnonzero(counts.sum(axis=1))
    rng = np.random.default_rng(11)
    p = {
        "context": rng.normal(0, 0.1, (k, d)), "target": rng.normal(0, 0.1, (k, d)),
        "one": np.eye(d) * 0.5, "two": np.eye(d) * 0.5, "bias": np.log(noise),
    }
    p = {name: x.astype(np.float32) for name, x in p.items()}
    if len(seen):
        n = counts[seen]
        tokens = n.sum(axis=1, keepdims=True)
        weight = (tokens / n.sum()).astype(np.float32)
        share = ((n + PRIOR * noise) / (tokens + PRIOR)).astype(np.float32)
        decay = np.float32(DECAY / n.sum())
        two, one = np.divmod(seen, k)
        first = {name: np.zeros_like(x) for name, x in p.items()}
        square = {name: np.zeros_like(x) for name, x in p.items()}
        offset = np.log(NOISE * noise).astype(np.float32)
        groups = [np.eye(k, dtype=np.float32)[x] for x in (one, two)]
        for step in range(1, ROUNDS + 1):
            if step % REDRAW == 1:  # NOISE noise tokens for each token
                drawn = (rng.poisson(NOISE * noise * tokens) / tokens).astype(np.float32)
            a, b = p["context"][one], p["context"][two]
            predicted = a @ p["one"] + b @ p["two"]
            odds = 1 / (1 + np.exp(np.clip(offset - p["bias"] - predicted @ p["target"].T, -60, 60)))  # that a token is no noise
            g = (share * (1 - odds) - drawn * odds) * weight
            back = g @ p["target"]
            grads = {
                "target": g.T @ predicted, "bias": g.sum(axis=0), "one": a.T @ back, "two": b.T @ back,
                "context": groups[0].T @ (back @ p["one"].T) + groups[1].T @ (back @ p["two"].T),
            }
            for name, x in grads.items():
                x -= decay * p[name] if name in ("context", "target") else 0
                first[name] = 0.9 * first[name] + 0.1 * x
                square[name] = 0.999 * square[name] + 0.001 * x * x
                p[name] += RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
    vectors = p["context"] @ p["one"], p["context"] @ p["two"]
    table = (vectors[1][:, None, :] + vectors[0][None, :, :]).reshape(k * k, d) @ p["target"].T + p["bias"]
    table -= table.max(axis=1, keepdims=True)
    table -= np.log(np.exp(table).sum(axis=1, keepdims=True))
    return (table / np.log(10)).astype(np.float32), _whitened(vectors[0].astype(float), counts.reshape(k, k, k).sum(axis=(0, 2)))


def _whitened(vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Vectors moved and stretched so that, over the corpus, they have mean 0 and no direction is longer than another."""
    if not weight.sum():
        return np.zeros_like(vectors)
    share = weight / weight.sum()
    centred = vectors - share @ vectors
    values, axes = np.linalg.eigh((centred * share[:, None]).T @ centred)
    return centred @ (axes / np.sqrt(np.maximum(values, 1e-3 * values.max() + 1e-12)))


def noise_counts(w: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Drawn numbers of noise tokens, word x class before: the whole part of the expected number, and one more with the probability of
    the rest. The draw is by word and class, so it is the same on every run."""
    at = mix(w.view(np.uint64)[:, None] + np.arange(1, expected.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    whole = np.floor(expected)
    return whole + ((at >> np.uint64(11)).astype(float) / 2.0**53 < expected - whole)


def target_vectors(seen: np.ndarray, noise: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Vectors t of words that tell their tokens (``seen``: word x class before) from noise by after @ t, by Newton's method: the log
    odds are after @ t - log NOISE, as the noise has the word's own share."""
    words, d = len(seen), after.shape[1]
    t = np.zeros((words, d))
    both = (after[:, :, None] * after[:, None, :]).reshape(len(after), d * d)
    ridge = RIDGE * np.eye(d)
    for _ in range(STEPS):
        odds = 1 / (1 + np.exp(np.clip(np.log(NOISE) - t @ after.T, -60, 60)))
        slope = (seen * (1 - odds) - noise * odds) @ after - RIDGE * t
        curve = ((seen + noise) * odds * (1 - odds)) @ both
        step = np.linalg.solve(curve.reshape(words, d, d) + ridge, slope[:, :, None])[:, :, 0]
        length = np.sqrt((step * step).sum(axis=1, keepdims=True))
        t += step * np.minimum(1.0, 2.0 / np.maximum(length, 1e-12))
    return t


def _word_vectors(words: DataFrame, contexts: DataFrame, head: Head, mass: np.ndarray, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """``w``, ``n``, and of words with a vector ``t`` (of the head) or ``u`` (of the rest: what it adds after each class). ``before``: counts of
    (class, class before)."""
    sent = words.sparkSession.sparkContext.broadcast((head, mass, before, after))
    seen = contexts.where("c >= 0").groupBy(F.col("w").alias("short")).agg(F.sum("n").alias("total"), F.collect_list(F.struct("c", "n")).alias("seen")).where(F.col("total") >= MIN_COUNT)
    rows = words.withColumn("short", F.col("w").bitwiseAND(F.lit(~int(_LAST)).cast("long"))).join(seen.select("short", "seen"), "short", "left").select("w", "size", "n", "seen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, mass, before, after = sent.value
        floats = pa.list_(pa.float32())
        for batch in batches:
            w, n = batch.column("w").to_numpy(), batch.column("n").to_numpy()
            place, classes = head.classify(w.view(np.uint64), batch.column("size").to_numpy())
            lists = batch.column("seen")
            some = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (classes > OWN) & (n >= MIN_COUNT))
            t, u = (np.full(batch.num_rows, None, object) for _ in range(2))
            for i in range(0, len(some), 256):
                part = some[i : i + 256]
                taken = lists.take(pa.array(part))
                flat, row = taken.flatten(), np.repeat(np.arange(len(part)), taken.value_lengths().to_numpy())
                found = np.zeros((len(part), CLASSES))
                found[row, flat.field("c").to_numpy()] = flat.field("n").to_numpy()
                c = classes[part]
                expected = NOISE * ((n[part] + 1) / mass[c])[:, None] * before[c]
                vectors = target_vectors(found, noise_counts(w[part], expected), after)
                for k, vector, added in zip(part.tolist(), vectors.astype(np.float32), (vectors @ after.T).astype(np.float32)):
                    if place[k] >= 0:
                        t[k] = vector
                    else:
                        u[k] = added
            yield pa.RecordBatch.from_arrays([batch.column("w"), batch.column("n"), pa.array(classes.astype(np.int32)), pa.array(t.tolist(), floats), pa.array(u.tolist(), floats)], ["w", "n", "class", "t", "u"])

    return rows.mapInArrow(run, "w long, n long, class int, t array<float>, u array<float>")


def _mass_shift(vectors: DataFrame, after: np.ndarray) -> np.ndarray:
    """What the words' vectors add to the mass of each class after each class: batched products of all words with all contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, CLASSES))
        for batch in batches:
            share, classes = batch.column("n").to_numpy() + 1.0, batch.column("class").to_numpy()
            for name, width in (("t", DIMENSIONS), ("u", CLASSES)):
                some = np.flatnonzero(batch.column(name).is_valid().to_numpy(zero_copy_only=False))
                if len(some):
                    values = batch.column(name).take(pa.array(some)).flatten().to_numpy().reshape(-1, width).astype(float)
                    added = np.expm1(values @ after.T if name == "t" else values) * share[some, None]
                    np.add.at(total, classes[some], added)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["k", "v"])

    rows = vectors.where("t IS NOT NULL OR u IS NOT NULL").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(CLASSES**2)
    out[rows["k"].to_numpy()] = rows["v"].to_numpy()
    return out.reshape(CLASSES, CLASSES)


def fit(df: DataFrame, train_rows: Column, text: str = "text") -> Model:
    """Count and train on all rows where ``train_rows`` holds."""
    shared.bounded_batches(df.sparkSession)
    rows = df.where(train_rows).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = shared.write_table(_count_words(rows), "words")
    by_size = counts.groupBy("size").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    ends = rows.count()
    top = counts.where("n > 1").orderBy(F.desc("n"), "w").limit(HEAD).toArrow()
    w, size, n = (top[c].to_numpy() for c in ("w", "size", "n"))
    w = w.view(np.uint64) if w.dtype == np.int64 else w.astype(np.uint64)
    rank = np.arange(len(w))
    tier = np.minimum(np.log(np.maximum(rank - OWN, 0) + 1) / np.log(max(HEAD - OWN, 2)) * BY_RANK, BY_RANK - 1).astype(np.int64)
    classes = np.where(rank < OWN, 1 + rank, 1 + OWN + tier)
    mass = np.zeros(CLASSES)
    mass[END] = ends + 1
    mass += np.bincount(classes, weights=n + 1.0, minlength=CLASSES)
    for r in by_size:
        own = size == r["size"]
        mass[OWN + BY_RANK + r["size"]] += r["n"] + r["v"] - (n[own] + 1.0).sum()
    mass[1 + OWN + BY_RANK :] += 1
    order = np.argsort(w)
    head = Head(Words(w[order]), n[order].astype(np.int64), classes[order])
    contexts = shared.write_table(_count_contexts(rows, head), "contexts")
    of_classes = _class_counts(contexts)
    table, after = train(of_classes)
    mass = np.maximum(mass, 1)
    before = of_classes.reshape(CLASSES, CLASSES, CLASSES).sum(axis=0).T
    vectors = shared.write_table(_word_vectors(counts, contexts, head, mass, before, after), "vectors")
    for used in (counts, contexts):
        shared.drop_table(used)
    shift = _mass_shift(vectors, after)
    own = vectors.where("t IS NOT NULL").select("w", "t").toArrow()  # at most HEAD rows
    targets = np.zeros((len(w), DIMENSIONS), np.float32)
    if len(own):
        place = head.words.find(own["w"].to_numpy().view(np.uint64))
        targets[place] = own["t"].combine_chunks().flatten().to_numpy().reshape(-1, DIMENSIONS)
    tokens = sum(r["n"] for r in by_size) + ends
    return Model(head, tokens, sum(r["v"] for r in by_size) + (ends > 0), ends, mass, table, after, targets, shift, vectors.select("w", "n", "u"))


def score(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id", flag: str = "held_out") -> DataFrame:
    """The key and ``flag`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10 probabilities of the whole text)."""
    shared.bounded_batches(df.sparkSession)
    spark = df.sparkSession
    log_mass = np.log10(np.maximum(model.mass[:, None] + model.shift, 1e-9))
    sent = spark.sparkContext.broadcast((model.head, model.ends, log_mass, model.table, model.after / np.log(10), model.targets))
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(flag).alias("flag"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("flag", df.schema[flag].dataType), T.StructField("tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("plus", T.DoubleType()), T.StructField("path", T.DoubleType())])
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("w", T.LongType()), T.StructField("c", T.IntegerType()), T.StructField("times", T.LongType()), T.StructField("doc", whole)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, ends, log_mass, table, after, targets = sent.value
        targets = np.vstack([targets, np.zeros((1, DIMENSIONS), np.float32)])
        log_count = np.append(np.log10(head.counts + 1.0), 0.0)
        log_end = np.log10(ends + 1.0)
        flat = table.reshape(-1)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            rid = batch.column("rid").to_numpy()
            for i, j in windows(offsets):
                classes, contexts, (hashes, place, of), at = _walk(head, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                docs = j - i
                last = contexts % CLASSES
                steps = flat[contexts * CLASSES + classes].astype(np.float64) - log_mass[classes, last]
                inside = np.ones(len(classes), bool)
                inside[at[1:] - 1] = False
                last, common = last[inside], place >= 0
                steps[inside] += np.einsum("ij,ij->i", targets[place], after[last].astype(np.float32))
                sums = np.concatenate([[0.0], np.cumsum(steps)])
                path = sums[at[1:]] - sums[at[:-1]]
                logs = np.concatenate([[0.0], np.cumsum(log_count[place])])
                hits = np.concatenate([[0], np.cumsum(common)])
                plus = logs[of[1:]] - logs[of[:-1]] + log_end
                known = hits[of[1:]] - hits[of[:-1]] + (ends > 0)
                # rare words of each document, each once after each class, with its times
                doc = np.repeat(np.arange(docs), np.diff(of))[~common]
                w, c = hashes[~common], last[~common]
                order = np.lexsort((c, w, doc))
                doc, w, c = doc[order], w[order], c[order]
                first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (c[1:] != c[:-1]) | (doc[1:] != doc[:-1]))) if len(w) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(w)))
                n = len(first)
                ids = np.concatenate([rid[i:j], rid[i:j][doc[first]]]) if n else rid[i:j]
                spread = (rid[i:j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                none = pa.nulls
                parts = [pa.concat_arrays([batch.column(c).slice(i, docs), none(n, batch.column(c).type)]) for c in ("key", "flag")]
                parts += [pa.concat_arrays([pa.array(x, t), none(n, t)]) for x, t in ((np.diff(at), pa.int64()), (known.astype(np.int64), pa.int64()), (plus, pa.float64()), (path, pa.float64()))]
                mask = np.concatenate([np.zeros(docs, bool), np.ones(n, bool)])
                struct = pa.StructArray.from_arrays(parts, fields=[pa.field(f.name, p.type) for f, p in zip(whole.fields, parts)], mask=pa.array(mask))
                made = [pa.array(ids), pa.array(np.concatenate([spread, w[first].view(np.int64)])), pa.array(np.concatenate([np.zeros(docs, np.int32), c[first].astype(np.int32)])), pa.array(np.concatenate([np.zeros(docs, np.int64), times.astype(np.int64)])), struct]
                yield pa.RecordBatch.from_arrays(made, ["rid", "w", "c", "times", "doc"])

    flat = rows.mapInArrow(run, schema)
    joined = flat.join(model.rare, "w", "left")
    some = F.col("n").isNotNull() & (F.col("times") > 0)
    # a document's own row has times 0, and a chance match of its spread key adds nothing
    docs = joined.groupBy("rid").agg(
        F.sum(F.when(some, F.col("times") * F.log10(F.col("n") + 1.0)).otherwise(0.0)).alias("rare_plus"),
        F.sum(F.when(some, F.col("times")).otherwise(F.lit(0))).alias("rare_known"),
        F.sum(F.when(some, F.col("times") * F.coalesce(F.element_at("u", F.col("c") + 1).cast("double"), F.lit(0.0))).otherwise(0.0)).alias("rare_path"),
        F.max("doc.key").alias("key"), F.max("doc.flag").alias("flag"), F.max("doc.tokens").alias("tokens"),
        F.max("doc.known").alias("known"), F.max("doc.plus").alias("plus"), F.max("doc.path").alias("path"),
    )
    plus = F.col("plus") + F.col("rare_plus")
    return docs.select(
        F.col("key").alias(key), F.col("flag").alias(flag), F.col("tokens").alias("n_tokens"), (F.col("known") + F.col("rare_known")).alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"), (plus - F.col("tokens") * F.lit(model.floor)).alias("base_score"), (plus + F.col("path") + F.col("rare_path") / float(np.log(10))).alias("score"),
    )
