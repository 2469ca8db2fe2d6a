"""Quality classifier: naive Bayes support vectors.

A text's features are the kinds of n-grams that it has (0 or 1): byte 3-grams, words and
pairs of words, hashed to 2**18, and one of nine for the share of its pairs that are a word and the same word again (none, or by
factors of two), in places of their own. Each is scaled by
the log ratio of its share in the two classes; a linear classifier is fitted to the scaled,
length-normalised features with hinge loss, by dual coordinate descent, and mixed with its mean weight.

It is fitted on at most ``per_class`` labelled rows of each class, those whose key has the least hashes.

Defined results: a null text counts as empty, and an empty text is scored by the bias alone;
labels other than 0 and 1 and rows without key or label teach nothing; of several labels of one
key the least holds, of several texts the least teaches; if a class has no rows, every text gets score 0.5; repeated rows are scored each
for itself; a column named like a result is replaced.
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
from raywalk.llm.text import buffers, mix, windows, word_hashes

BITS = 18
#: Places for the share of repeats, after those of the hashed n-grams.
REPEATS = 9
SIZE = (1 << BITS) + REPEATS
#: Labelled rows of each class that the model is fitted on.
PER_CLASS = 2500
#: Share of the fitted weights; the rest is their mean size, as for naive Bayes alone.
BETA = 0.9
C = 1.0
ROUNDS = 12
#: Slope of the score in the margin.
SLOPE = 2.0


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct hashed features of each document, in no order."""
    seen = np.empty(SIZE, np.int64)
    shift = np.uint64(64 - BITS)
    for i, j in windows(offsets):
        at = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        words, of = word_hashes(part, at, folded=False)
        one = (words >> shift).astype(np.int64)
        two = (mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) >> shift).astype(np.int64) if len(words) > 1 else one[:0]
        same = words[:-1] == words[1:] if len(words) > 1 else np.zeros(0, bool)
        low = part.astype(np.uint32)
        three = (((low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64) if len(part) > 2 else np.zeros(0, np.int64)
        for k in range(j - i):
            a, b = of[k], of[k + 1]
            found = [one[a:b], three[at[k] : max(at[k], at[k + 1] - 2)]]
            if b - a > 1:
                found.append(two[a : b - 1])
                found.append(np.array([_repeats(float(same[a : b - 1].mean()))]))
            found = np.concatenate(found)
            order = np.arange(len(found))
            seen[found] = order
            yield found[seen[found] == order]


def _repeats(share: float) -> int:
    return (1 << BITS) + (0 if not share else 1 + min(REPEATS - 2, int(-np.log2(share))))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum()) / max(1.0, np.sqrt(len(found))) + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margins = np.fromiter((self.margin(f) for f in features(data, offsets)), float, len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(SLOPE * margins, -500, 500)))


def train(rows: Kept | list[np.ndarray], labels: np.ndarray) -> Model:
    """Log-count ratios, then dual coordinate descent for the hinge loss, with costs that balance the classes."""
    size = SIZE
    good, bad = np.ones(size), np.ones(size)
    for i, y in enumerate(labels):
        (good if y == 1 else bad)[rows[i]] += 1
    n_good, n_bad = int((labels == 1).sum()), int((labels != 1).sum())
    if not n_good or not n_bad:
        return Model(np.zeros(size), 0.0)
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    sign = np.where(labels == 1, 1.0, -1.0)
    cost = np.where(labels == 1, C * len(rows) / (2 * n_good), C * len(rows) / (2 * n_bad))

    def scaled(found: np.ndarray) -> np.ndarray:
        return ratio[found] / max(1.0, np.sqrt(len(found)))

    norm = np.array([float(x @ x) + 1.0 for x in (scaled(rows[i]) for i in range(len(rows)))])
    rng = np.random.default_rng(5)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            found = rows[i]
            x = scaled(found)
            gradient = sign[i] * (w[found] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[found] += step * x
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    used = np.abs(w) > 1e-9  # not what rounding leaves of a weight that was taken back
    w[used] = BETA * w[used] + (1 - BETA) * np.abs(w[used]).mean()
    return Model(w * ratio, bias)


def _kept(found: np.ndarray) -> bytes:
    """Sorted features as they are or, if that is shorter, as a bit for each feature: 32 KB at most."""
    found = np.sort(found).astype(np.int32)
    if 32 * len(found) < SIZE:
        return b"i" + found.tobytes()
    bits = np.zeros(SIZE, bool)
    bits[found] = True
    return b"b" + np.packbits(bits).tobytes()


class Kept:
    """Rows of features that are unpacked as they are read."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> np.ndarray:
        found = self.packed[i]
        return np.frombuffer(found, np.int32, offset=1) if found[:1] == b"i" else np.flatnonzero(np.unpackbits(np.frombuffer(found, np.uint8, offset=1)))


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, text: str = "text", label: str = "quality", key: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    """Fit on the labelled documents where ``train_rows`` holds, a bounded sample of each class: the driver gets 32 KB of each at most."""
    spark = docs.sparkSession
    shared.bounded_batches(spark)
    base = docs.where(train_rows).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marks = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where(F.col("label").isin(0, 1) & F.col("key").isNotNull())
    marks = marks.groupBy("key").agg(F.min("label").alias("label"))
    known = base.select("key").distinct().join(marks, "key")
    order = F.xxhash64("key", F.lit("quality"))
    picked = [known.where(F.col("label") == y).orderBy(order, "key").limit(per_class) for y in (0, 1)]
    chosen = picked[0].union(picked[1]).collect()  # at most 2 * per_class keys
    some = spark.createDataFrame([(r["key"], int(r["label"])) for r in chosen], T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("label", T.IntegerType())]))
    rows = base.join(F.broadcast(some), "key").groupBy("key", "label").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_kept(f) for f in features(*buffers(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(found, pa.binary())], ["key", "label", "found"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("label", T.IntegerType()), T.StructField("found", T.BinaryType())])
    table = rows.mapInArrow(extract, schema).toArrow()
    got = sorted(zip(table["key"].to_pylist(), table["label"].to_pylist(), table["found"].to_pylist()))
    return train(Kept([f for _, _, f in got]), np.array([y for _, y, _ in got], np.int64))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher: class 1 likelier) and ``predicted`` (1 if score >= 0.5)."""
    shared.bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c not in ("score", "predicted")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.scores(*buffers(batch.column(text)))
            made = [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, "score", "predicted"])

    kept = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name in names]
    return df.mapInArrow(judge, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
