"""Text operators against plain Python, and their edge cases."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from raywalk.llm import bpe, langid, lm, quality, queries, text

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_are_split_and_hashed_alike(texts):
    import pyarrow as pa

    data, offsets = text.buffers(pa.array(texts, pa.string()))
    hashes, of = text.word_hashes(data, offsets)
    words = [t.encode().lower().split() for t in texts]
    assert np.diff(of).tolist() == [len(w) for w in words]
    by_word = {}
    for h, w in zip(hashes.tolist(), (x for w in words for x in w)):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_windows_cover_all_documents():
    offsets = np.array([0, 5, 5, 9, 40, 41])
    assert list(text.windows(offsets, 10)) == [(0, 3), (3, 4), (4, 5)]


@given(st.lists(st.binary(max_size=12), unique=True, max_size=300))
@settings(max_examples=30, deadline=None)
def test_perfect_hash_is_minimal(keys):
    made = bpe.PerfectHash(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_encoding_is_that_of_the_library(reference, t):
    codec = bpe.Codec.of(PATH, public_tokenizers.PATTERN)
    (ids,) = codec.encode([t])
    ids = np.frombuffer(ids, np.int32)
    assert ids.tolist() == reference.encode_ordinary(t)
    assert bpe.Decoder.of(PATH).decode(ids) == t.encode()


def test_bpe_query_on_every_text(spark, reference):
    got = {r["doc_id"]: r for r in queries.op2_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_bpe_edges(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "x" * 50_000, 7), (3, "x" * 50_000, 7), (None, "\r\n é", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    done = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH)
    assert done.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted(bytes(r["decoded"]) for r in done.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    once = bpe.transcode(df, PATH, public_tokenizers.PATTERN)
    assert once.columns == done.columns and sorted(map(str, once.collect())) == sorted(map(str, done.collect()))
    assert bpe.digests(done).where("doc_id = 1").first()["n_tokens"] == 0
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    bad = spark.createDataFrame([([50_300],)], "ids array<int>")
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(bad, PATH).collect()
    none = spark.createDataFrame([(None,)], "ids array<int>")
    assert bytes(bpe.decode(none, PATH).first()["decoded"]) == b""


def test_memo_may_forget(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    codec = bpe.Codec(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    texts = ["the quick brown fox", "jumps over the lazy dog " * 3, "zzqx 12 34 !!", None]
    assert [np.frombuffer(x, np.int32).tolist() for x in codec.encode(texts)] == [reference.encode_ordinary(t or "") for t in texts]


def test_codewords_tell_languages_apart():
    for k in (2, 3, 4, 7, 12, 40):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k
        assert all(0 < c.sum() < k for c in code.T)


def test_language_accuracy_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op10_langid(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 150 and right / n > 0.97
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en", 0), (2, "der hund und die katze", "de", 0), (2, "der hund und die katze", "de", 0), (3, None, "en", 0), (4, "", "de", 0), (5, "123 !!", "en", 0), (None, "the the", None, 0), (6, "a", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    found = langid.identify(df, langid.fit(df, F.lit(True)))
    by = {(r["doc_id"], r["text"]): r for r in found.collect()}
    assert found.count() == len(rows)
    for t in (None, "", "123 !!"):
        r = next(v for k, v in by.items() if k[1] == t)
        assert (r["lang_pred"], r["score"], r["ambiguous"]) == (langid.UND, 0.0, True)
    assert by[1, "the cat and the dog"]["lang_pred"] == "en" and by[2, "der hund und die katze"]["lang_pred"] == "de"
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit(df, F.lit(False))).collect()} == {langid.UND}
    one = langid.identify(df, langid.fit(df, F.col("lang") == "en")).where("doc_id = 2").first()
    assert (one["lang_pred"], one["score"]) == ("en", 1.0)
    assert langid.identify(df.limit(0), langid.fit(df, F.lit(True))).count() == 0


def test_language_by_plain_naive_bayes(spark):
    """Counts, bits, trust and decoding again, a document and a gram at a time."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]

    def grams(t):
        low = bytes((b | 32) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in t.encode())
        low = bytearray(low)
        for i in range(len(low) - 1):
            if t.encode()[i] == 0xC3 and 0x80 <= t.encode()[i + 1] <= 0x9E and t.encode()[i + 1] != 0x97:
                low[i + 1] += 32
        return [((low[i] | low[i + 1] << 8 | low[i + 2] << 16) * 2654435761 % 2**32) >> 16 for i in range(len(low) - 2)]

    learnt = {(lang, t) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and lang is not None}
    names = sorted({lang for lang, t in learnt if len(t.encode()) > 2})
    assert all(sum(lang == n for lang, _ in learnt) <= langid.PER_LANGUAGE for n in names)
    counts = {n: Counter(g for lang, t in learnt if lang == n for g in grams(t)) for n in names}
    total = {n: sum(counts[n].values()) + 0.5 * 65536 for n in names}
    splits = [[s >> k - 1 & 1 if k else 0 for k in range(len(names))] for s in range(1, 1 << (len(names) - 1))]

    def weight(g, split):
        share = lambda b: [(counts[n][g] + 0.5) / total[n] for n, x in zip(names, split) if x == b]
        one, zero = share(1), share(0)
        return math.log(sum(one) / len(one)) - math.log(sum(zero) / len(zero))

    memo = {}

    def margins(t):
        found = grams(t)
        out = []
        for k, split in enumerate(splits):
            for g in set(found):
                if (g, k) not in memo:
                    memo[g, k] = weight(g, split)
            out.append(sum(memo[g, k] for g in found) / math.sqrt(len(found)) if found else 0.0)
        return out

    taught = [(margins(t), names.index(lang)) for lang, t in learnt if lang in names]
    rate = [(sum((m[k] > 0) == (s[at] == 1) for m, at in taught) + 1) / (len(taught) + 2) for k, s in enumerate(splits)]
    trust = [max(math.log(r / (1 - r)), 0.01) for r in rate]
    got = {r["doc_id"]: r for r in queries.op10_langid(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        m = margins(t)
        loss = [sum(w * len(trust) / sum(trust) * math.log1p(math.exp(-x * (2 * s[k] - 1))) for x, w, s in zip(m, trust, splits)) for k in range(len(names))]
        assert r["lang_pred"] == names[loss.index(min(loss))]
        assert r["score"] == pytest.approx(1 / sum(math.exp(min(loss) - x) for x in loss), abs=1e-4)


def test_language_of_clashing_names_repeats_and_long_texts(spark):
    rows = [(i, "the cat and the dog went home", "en") for i in range(300)] + [(1, "der hund und die katze gehen", "de"), (2, "und " * 300_000, "de"), (3, "ab", "fr"), (None, "the " * 300_000, None)]
    df = spark.createDataFrame([(*r, "own", 1.5) for r in rows], "doc_id long, text string, lang string, _letter string, _Letter_ double").repartition(3)
    drawn = langid.sample(df, "text", "lang", F.lit(True), 1000).collect()
    assert sorted(r["label"] for r in drawn) == ["de", "de", "en", "fr"]
    model = langid.fit(df, F.lit(True))
    assert model.languages == ["de", "en"]
    got = langid.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang", "_letter", "_Letter_", "lang_pred", "score", "lead", "ambiguous"]
    by = {r["text"]: r for r in got.collect()}
    assert by["und " * 300_000]["lang_pred"] == "de" and by["the " * 300_000]["lang_pred"] == "en" and {r["_letter"] for r in by.values()} == {"own"}


def test_quality_accuracy_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op3_quality(spark, sf).where("held_out").join(labels, "doc_id")
    rows = {r["quality"]: r for r in got.groupBy("quality").agg(F.avg(F.col("predicted").cast("double")).alias("p"), F.count("*").alias("n")).collect()}
    assert rows[0]["n"] > 50 and rows[0]["p"] < 0.05 and rows[1]["p"] > 0.95


def test_quality_edges(spark):
    good, bad = "some plain words that make a sentence", "!!! ### !!! ###"
    df = spark.createDataFrame([(1, good), (2, bad), (3, None), (4, ""), (5, good + " again"), (6, bad + " $$$"), (6, bad + " $$$"), (None, good)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (5, 1), (6, 0), (9, 1), (None, 0), (3, 7), (4, None)], "doc_id long, quality int")
    found = quality.score(df, quality.fit(df, labels, F.lit(True))).collect()
    assert len(found) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert {r["doc_id"]: r["predicted"] for r in found if r["doc_id"] in (1, 2, 5, 6)} == {1: 1, 2: 0, 5: 1, 6: 0}
    alone = quality.score(df, quality.fit(df, labels.where("quality = 1"), F.lit(True))).collect()
    assert {r["score"] for r in alone} == {0.5}
    assert quality.score(df.limit(0), quality.fit(df.limit(0), labels, F.lit(True))).count() == 0


def test_descent_solves_a_small_problem():
    rows = [np.array(r) for r in ([1, 2], [1, 3], [4, 5], [4, 6])]
    model = quality.train(rows, np.array([1, 1, 0, 0]))
    assert [model.margin(r) > 0 for r in rows] == [True, True, False, False]


def test_quality_by_dense_descent(spark):
    """Features from plain Python, the fit on dense rows, every score again."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] in (0, 1)}
    teach = sorted(i for i in docs if i in labels and zlib.crc32(str(i).encode()) % 3 != 1)
    assert all(sum(labels[i] == q for i in teach) <= quality.PER_CLASS for q in (0, 1))
    names = {}

    def grams(t):
        raw = t.encode()
        words = [w for w in __import__("re").findall(rb"[^ \t-\r]+", raw)]
        found = {("w", w) for w in words} | {("p", a, b) for a, b in zip(words, words[1:])} | {("b", raw[i : i + 3]) for i in range(len(raw) - 2)}
        if len(words) > 1:
            same = sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1)
            found.add(("r", 0 if not same else 1 + min(7, int(-math.log2(same)))))
        return found

    import pyarrow as pa

    # hashing may join n-grams: take the module's places for them, having checked that there are no more places than n-grams
    def placed(t):
        (own,) = quality.features(*text.buffers(pa.array([t])))
        return own

    rows = {}
    for i, t in docs.items():
        own, plain = placed(t), grams(t)
        names.update((x, None) for x in plain)
        assert len(set(own.tolist())) == len(own) <= len(plain) and len(own) > 0.97 * len(plain) - 1
        rows[i] = own
    x = np.zeros((len(teach), quality.SIZE), bool)
    for k, i in enumerate(teach):
        x[k, rows[i]] = True
    y = np.array([labels[i] for i in teach])
    p, q = 1 + x[y == 1].sum(axis=0), 1 + x[y == 0].sum(axis=0)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    dense = x * ratio / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
    s = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())) * quality.C
    w, bias, alpha, rng = np.zeros(quality.SIZE), 0.0, np.zeros(len(y)), np.random.default_rng(5)
    for _ in range(quality.ROUNDS):
        before = alpha.copy()
        for k in rng.permutation(len(y)):
            new = min(max(alpha[k] - (s[k] * (dense[k] @ w + bias) - 1) / (dense[k] @ dense[k] + 1), 0.0), cost[k])
            w, bias, alpha[k] = w + (new - alpha[k]) * s[k] * dense[k], bias + (new - alpha[k]) * s[k], new
        if np.abs(alpha - before).max() < 1e-3:
            break
    used = np.abs(w) > 1e-9
    mean = np.abs(w[used]).mean()
    w = np.where(used, quality.BETA * w + (1 - quality.BETA) * mean, 0.0)
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, own in rows.items():
        margin = (w * ratio)[own].sum() / max(1.0, math.sqrt(len(own))) + bias
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-quality.SLOPE * margin)), abs=1e-6)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i]["predicted"] == (got[i]["score"] >= 0.5)


def test_quality_of_clashing_names_repeats_and_long_texts(spark):
    good, bad = "some plain words that make a sentence", "!!! ### !!! ###"
    rows = [(1, good)] * 50 + [(1, "zz" + good), (2, bad), (3, " ".join(f"w{i}" for i in range(400_000))), (4, bad * 200_000), (5, None)]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, _key string, label int")
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (3, 1, "x"), (4, 0, "x")], "doc_id long, quality int, text string")
    model = quality.fit(df, labels, F.col("label") == 1)
    got = quality.score(df, model)
    assert got.columns == ["doc_id", "text", "_key", "label", "score", "predicted"] and got.count() == len(rows)
    assert {(r["doc_id"], r["predicted"]) for r in got.where("doc_id < 5").collect()} == {(1, 1), (2, 0), (3, 1), (4, 0)}
    many = np.flatnonzero(np.random.default_rng(3).random(quality.SIZE) < 0.3)
    for found in (many, many[:100], many[:0]):
        packed = quality._kept(found)
        assert len(packed) <= 1 + -(-quality.SIZE // 8) and quality.Kept([packed])[0].tolist() == found.tolist()


def test_lm_scores_by_brute_force(spark):
    sf = SF
    docs = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = Counter()
    for i, words in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words, None])
    total, distinct = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in queries.op9_lm(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, words in docs:
        tokens, r = [*words, None], got[i]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and math.isfinite(r["score"]) and r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_probabilities_add_up(spark):
    """Over all words that were seen, and one unseen for each rare class, with the end mark."""
    df = spark.createDataFrame([(1, "a b a c", False), (2, "a b dd", False)], "doc_id long, text string, held_out boolean")
    model = lm.fit(df, F.lit(True))
    assert np.allclose((10.0 ** model.table.astype(float)).sum(axis=1), 1, atol=1e-4)
    assert (model.tokens, model.distinct, model.ends) == (9, 5, 2)
    seen = model.head.counts + 1
    inside = np.bincount(model.head.classes, weights=seen, minlength=lm.CLASSES)
    inside[lm.END] += model.ends + 1
    inside[1 + lm.OWN + lm.BY_RANK :] += 1
    inside[lm.OWN + lm.BY_RANK + 1] += 2  # c, which occurs once, by its length
    inside[lm.OWN + lm.BY_RANK + 2] += 2  # dd
    assert np.allclose(inside[inside > 0], model.mass[inside > 0])


def test_lm_score_by_brute_force(spark):
    """Counts by word and class again, a vector of every word that fits them, probabilities that add up to 1, and scores token by token."""
    rng = np.random.default_rng(15)
    names = [f"w{'x' * int(rng.integers(0, 5))}{i}" for i in range(400)]
    share = 1 / np.arange(1, 401) ** 0.7
    share /= share.sum()
    texts = []
    for _ in range(500):
        words, at = [], int(rng.integers(400))
        for _ in range(int(rng.integers(0, 40))):
            at = (at * 7 + 3) % 400 if rng.random() < 0.5 else int(rng.choice(400, p=share))
            words.append(names[at])
        texts.append(words)
    rows = [(i, " ".join(w), i % 5 == 0) for i, w in enumerate([*texts, ["unseen", "w", "new"]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    old = lm.HEAD
    try:
        lm.HEAD = 250  # the driver's: the other words have their counts and vectors by the join
        model = lm.fit(df, ~F.col("held_out"))
        got = {r["doc_id"]: r["score"] for r in lm.score(df, model).collect()}
    finally:
        lm.HEAD = old
    taught = [t.split() for _, t, held in rows if not held]
    counts = Counter(w for t in taught for w in t)
    hashed = lambda w: text.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]
    every = [*counts, "unseen", "w", "new"]
    classes = {w: int(model.head.classify(np.array([hashed(w)]), np.array([len(w)]))[1][0]) for w in every}
    assert len(model.head.counts) == 250 and sum(c > lm.OWN for c in classes.values()) > 200

    def walk(words):
        two, one = lm.END, lm.END
        for w in [*words, None]:
            c = lm.END if w is None else classes[w]
            yield w, c, two, one
            two, one = one, c

    seen, before = {w: np.zeros(lm.CLASSES) for w in every}, np.zeros((lm.CLASSES, lm.CLASSES))
    for t in taught:
        for w, c, _, one in walk(t):
            before[c, one] += 1
            if w is not None:
                seen[w][one] += 1
    added = {}
    for w in every:
        c = classes[w]
        t = np.zeros(lm.DIMENSIONS)
        if c > lm.OWN and counts[w] >= lm.MIN_COUNT:
            noise = lm.noise_counts(np.array([hashed(w)]).view(np.int64), (lm.NOISE * (counts[w] + 1) / model.mass[c] * before[c])[None])[0]
            assert np.all(np.abs(noise - lm.NOISE * (counts[w] + 1) / model.mass[c] * before[c]) < 1)
            t = lm.target_vectors(seen[w][None], noise[None], model.after)[0]
            odds = 1 / (1 + np.exp(np.log(lm.NOISE) - model.after @ t))
            assert np.abs((seen[w] * (1 - odds) - noise * odds) @ model.after - lm.RIDGE * t).max() < 1e-3
            place = int(model.head.words.find(np.array([hashed(w)]))[0])
            if place >= 0:
                assert np.allclose(model.targets[place], t, atol=1e-4)
        added[w] = model.after @ t
    assert max(np.abs(x).max() for x in added.values()) > 0.1

    def probability(w, c, two, one):
        inside = sum((counts[v] + 1) * math.exp(added[v][one]) for v in counts if classes[v] == c) + (c > lm.OWN + lm.BY_RANK)
        part = 1.0 if c <= lm.OWN else (counts[w] + 1) * math.exp(added[w][one]) / inside
        return 10 ** float(model.table[two * lm.CLASSES + one, c]) * part

    for two, one in ((0, 0), (1, 5), (classes[names[7]], classes[names[300]])):
        total = sum(probability(w, classes[w], two, one) for w in counts) + probability(None, lm.END, two, one)
        for c in set(range(lm.CLASSES)) - {classes[w] for w in counts} - {lm.END}:
            total += 10 ** float(model.table[two * lm.CLASSES + one, c])  # classes of unseen words
        for c in {classes[w] for w in counts if classes[w] > lm.OWN + lm.BY_RANK}:
            inside = sum((counts[v] + 1) * math.exp(added[v][one]) for v in counts if classes[v] == c) + 1
            total += 10 ** float(model.table[two * lm.CLASSES + one, c]) / inside
        assert total == pytest.approx(1, abs=1e-4)
    for i, t, _ in rows[:60] + rows[-1:]:
        assert got[i] == pytest.approx(sum(math.log10(probability(w, c, two, one)) for w, c, two, one in walk(t.split())), rel=1e-4, abs=1e-4)


def test_lm_edges(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 2)
    rows = [(1, "a a a b b c", False), (2, None, False), (2, "", False), (None, "zz zz c " * 50, True), (3, "A  a\tB\nc", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    model = lm.fit(df, ~F.col("held_out"))
    got = lm.score(df, model).collect()
    assert len(got) == 5 and {r["n_tokens"] for r in got if r["doc_id"] == 2} == {1}
    counts = {b"a": 3, b"b": 2, b"c": 1, None: 3}
    for r in got:
        t = next(t for i, t, _ in rows if i == r["doc_id"])
        tokens = [*(t or "").encode().lower().split(), None]
        assert r["n_known"] == sum(w in counts for w in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (9 + 4 + 1)) for w in tokens))
    none = lm.score(df, lm.fit(df, F.lit(False))).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)
    assert lm.score(df.limit(0), model).count() == 0
