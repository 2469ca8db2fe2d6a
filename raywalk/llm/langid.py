"""Language identification by error-correcting output codes.

Each language has a binary codeword. For each bit, a naive Bayes classifier on hashed byte
3-grams of folded text tells the languages with a 1 from those with a 0. A text's language is
the codeword of least loss: a logistic loss of each bit's margin, weighted by how well
that bit does on the sample. A small lead of the best codeword flags the text as ambiguous.

The models are fitted on a sample of about ``per_language`` different labelled texts for each language (all, if
there are fewer), taken by a hash of the text, so that it is the same on every run and however often a text or a
key is repeated. Languages are any number: the driver holds one language's counts at a time.

Defined results: a null or empty text, or one without a letter, is ``und`` with score 0 and
ambiguous; rows without text or language teach nothing; with no labelled rows at all every text is ``und``;
with one language, every text with a letter is of it; equal losses go to the language that sorts
first; a language whose sampled texts are all under three bytes isn't learnt; repeated rows are judged each for
itself and teach once; a column named like a result is replaced, any other name may occur in the input.
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
from raywalk.llm.text import buffers, windows

UND = "und"
BITS = 16
#: Sample texts for each language.
PER_LANGUAGE = 1000
#: Lead in loss over the second language, a bit, under which a text is ambiguous.
MIN_LEAD = 0.05

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 letters in lower case and other ASCII as spaces."""
    out = _FOLD[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def grams(data: np.ndarray) -> np.ndarray:
    """Hashed 3-grams: entry i covers bytes i to i + 2."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    low = folded(data).astype(np.uint32)
    key = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def codewords(k: int) -> np.ndarray:
    """k codewords of 0 and 1: all splits in two for up to 7 languages, else random ones far apart."""
    if k <= 1:
        return np.zeros((k, 0), np.int8)
    if k <= 7:
        splits = np.arange(1, 1 << (k - 1))
        return np.vstack([np.zeros(len(splits), np.int8), *((splits >> b & 1).astype(np.int8) for b in range(k - 1))])
    rng, width, best = np.random.default_rng(7), int(np.ceil(10 * np.log2(k))), (-1, None)
    for _ in range(20):
        code = rng.integers(0, 2, (k, width), dtype=np.int8)
        code[:, code.sum(0) == 0] ^= np.arange(k, dtype=np.int8)[:, None] & 1
        signs = code * 2.0 - 1
        apart = (width - signs @ signs.T) / 2
        least = (apart + np.eye(k) * width).min()
        if least > best[0]:
            best = least, code
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit, 0 or 1
    weights: np.ndarray  # 3-gram x bit
    trust: np.ndarray  # bit; adds up to the number of bits

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scaled log odds of each bit, document by document."""
        out = np.zeros((len(offsets) - 1, self.weights.shape[1]))
        for i, j in windows(offsets):
            at = offsets[i : j + 1] - offsets[i]
            index = grams(data[offsets[i] : offsets[j]])
            for k in range(j - i):
                n = at[k + 1] - at[k] - 2
                own = index[at[k] : at[k] + max(n, 0)]
                if n > 1 << BITS:  # a long text by counts, in memory that doesn't grow with it
                    out[i + k] = np.bincount(own, minlength=1 << BITS) @ self.weights.astype(float) / np.sqrt(n)
                elif n > 0:
                    out[i + k] = self.weights[own].sum(axis=0) / np.sqrt(n)
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted loss of each language: document x language."""
        out = np.zeros((len(margins), len(self.languages)))
        for k, word in enumerate(self.code):
            out[:, k] = np.logaddexp(0, -margins * (word * 2.0 - 1)) @ self.trust
        return out


def sample(df: DataFrame, text: str, label: str, train: Column, per_label: int) -> DataFrame:
    """``label`` and ``text`` of about ``per_label`` different texts of each label among the ``train`` rows, by a hash of
    the text: bounded in expectation, as a text that is repeated is drawn once or not at all."""
    rows = df.where(train).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).where("label IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("label").count().withColumn("rate", F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("count"))).select("label", "rate")
    draw = F.pmod(F.xxhash64("text", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(counts), "label").where(draw < F.col("rate")).select("label", "text").distinct()


def fit(df: DataFrame, train: Column, text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the rows where ``train`` holds."""
    shared.bounded_batches(df.sparkSession)
    rows = shared.write_table(sample(df, text, label, train, per_language), "langid-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, total in found.items():
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], ["label", "gram", "n"])
            found.clear()

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for k, name in enumerate(batch.column("label").to_pylist()):
                if name not in found and len(found) == 100:
                    yield from out()
                total = found.setdefault(name, np.zeros(1 << BITS, np.int64))
                total += np.bincount(grams(data[offsets[k] : offsets[k + 1]]), minlength=1 << BITS)
        yield from out()

    def dense(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << BITS, np.int64)
        total[table["gram"].to_numpy()] = table["n"].to_numpy()
        return pa.table({"label": table["label"][:1], "n": pa.array([total.tobytes()], pa.binary())})

    counts = rows.mapInArrow(count, "label string, gram int, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    counts = shared.write_table(counts.groupBy("label").applyInArrow(dense, "label string, n binary"), "langid-counts")
    names = sorted(r["label"] for r in counts.select("label").collect())  # the languages that the model tells apart
    code = codewords(len(names))
    one, zero = (np.zeros((1 << BITS, code.shape[1])) for _ in range(2))
    for r in counts.orderBy("label").toLocalIterator():
        share = np.frombuffer(r["n"], np.int64) + 0.5
        share /= share.sum()
        bits = code[names.index(r["label"])] == 1
        one[:, bits] += share[:, None]
        zero[:, ~bits] += share[:, None]
    ones = code.sum(axis=0)
    weights = (np.log(one / ones) - np.log(zero / (len(names) - ones))).astype(np.float32)
    model = Model(names, code, weights, np.ones(code.shape[1]))
    if code.shape[1]:
        model.trust = _trust(rows, model)
    shared.drop_table(rows)
    shared.drop_table(counts)
    return model


def _trust(rows: DataFrame, model: Model) -> np.ndarray:
    """Weights of the bits: the log odds that they are right on the sample."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        place = {name: k for k, name in enumerate(m.languages)}
        for batch in batches:
            of = np.array([place.get(x, -1) for x in batch.column("label").to_pylist()], np.int64)
            margins, of = m.margins(*buffers(batch.column("text")))[of >= 0], of[of >= 0]
            hits = ((margins > 0) == (m.code[of] == 1)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hits), dtype=np.int32)), pa.array(hits.astype(np.int64)), pa.array(np.full(len(hits), len(of), np.int64))], ["bit", "hits", "n"])

    got = rows.mapInArrow(right, "bit int, hits long, n long").groupBy("bit").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).toPandas().sort_values("bit")
    rate = (got["hits"].to_numpy() + 1) / (got["n"].to_numpy() + 2)
    odds = np.maximum(np.log(rate / (1 - rate)), 0.01)
    return odds / odds.mean()


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1), ``lead`` (in loss over the second language, a bit) and ``ambiguous``."""
    shared.bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    made = ["lang_pred", "score", "lead", "ambiguous"]
    names = [c for c in df.columns if c not in made]
    flag = shared.free_name(df, "_letter")
    lettered = df.select(*(F.col(f"`{c}`") for c in names), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(flag))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n = batch.num_rows
            some = batch.column(flag).to_numpy(zero_copy_only=False).astype(bool) & (len(m.languages) > 0)
            best, score, lead = np.zeros(n, np.int64), some.astype(float), np.where(some, np.inf, 0.0)
            if len(m.languages) > 1 and n:
                loss = m.losses(m.margins(*buffers(batch.column(text))))
                best = loss.argmin(axis=1)
                near = np.exp(loss.min(axis=1, keepdims=True) - loss)
                score = np.where(some, 1 / near.sum(axis=1), 0.0)
                two = np.partition(loss, 1, axis=1)
                lead = np.where(some, (two[:, 1] - two[:, 0]) / m.code.shape[1], 0.0)
            pred = [m.languages[k] if s else UND for k, s in zip(best.tolist(), some.tolist())]
            columns = [pa.array(pred, pa.string()), pa.array(score), pa.array(np.minimum(lead, 1e9)), pa.array(lead < MIN_LEAD)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, *made])

    kept = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name in names]
    more = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("lead", T.DoubleType()), ("ambiguous", T.BooleanType())]
    return lettered.mapInArrow(judge, T.StructType([*kept, *(T.StructField(n, k) for n, k in more)]))
