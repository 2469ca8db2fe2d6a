"""The whole detection: against a plain transcription, fixed numbers, and its invariances."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raywalk.operators import numeric
from raywalk.operators.polar import ray_directions
from raywalk.params import Params
from raywalk.plans.pipeline import Detector, detect, score_with

DATA = "/root/testdata"


def series(spark, values, parts=3):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, value double").repartition(parts)


def plain(v, p):
    """The method in one piece, step by step, with no sharing of sums."""
    n = len(v)
    conv = np.array([v[k : k + p.convolution].sum() for k in range(n - p.convolution)])
    rows = np.array([conv[i : i + p.width] for i in range(n - p.length + 1)])
    means = rows.mean(axis=0)
    pc = np.linalg.svd(rows - means, full_matrices=False)[2][:3].T
    pc = pc * np.where(pc[0] < 0, -1, 1)
    ref = (p.convolution * v.min() - means) @ pc
    z = numeric.rotation_to_z(ref) @ ((rows - means) @ pc).T
    x, y = z[0], z[1]
    extent, radius = p.scale * max(np.abs(x).max(), np.abs(y).max()), math.hypot(np.abs(x).max(), np.abs(y).max())
    t, s, d = numeric.crossings(x, y, p.segments, radius, np.array([r[1:] for r in ray_directions(p.segments)]))
    points = np.arange(p.grid) * extent / p.grid
    node = np.zeros(len(s), np.int64)
    for k in range(p.segments):
        own = d[s == k]
        found = np.zeros(0)
        if len(own) > 1 and own.var(ddof=1) > 0:
            w = len(own) ** 0.2 / own.std(ddof=1)
            density = np.array([np.exp(-0.5 * ((own - g) * w) ** 2).sum() / len(own) for g in points])
            found = points[numeric.maxima(density)]
        node[s == k] = [int(np.abs(found - a).argmin()) if len(found) else 0 for a in own]
    slots, last, j = [], None, 0
    for i in range(len(x) - 1):
        here = []
        while j < len(t) and t[j] == i:
            now = (int(s[j]), int(node[j]))
            if last is not None:
                here.append((last, now))
            last, j = now, j + 1
        if not here and last is not None and not (j and t[j - 1] == i):
            here.append((last, last))
        if here:
            slots.append((i, here))
    weight, ends = {}, {}
    for _, here in slots:
        for e in here:
            weight[e] = weight.get(e, 0) + 1
    for a, b in weight:
        ends[a] = ends.get(a, 0) + 1
        ends[b] = ends.get(b, 0) + 1
    worth = [(sum(weight[e] * (ends[e[0]] - 1) for e in here), len(here)) for _, here in slots]
    paths = [sum(w for w, _ in worth[k : k + p.query]) / sum(c for _, c in worth[k : k + p.query]) for k in range(len(worth) - p.query + 1)]
    low, high = min(paths), max(paths)
    z = [(high - a) / (high - low) for a in paths]
    return slots[0][0], [sum(z[k : k + p.length]) / p.length for k in range(len(z) - p.length + 1)]


def ordered(df):
    rows = df.orderBy("start_idx").collect()
    return [r["start_idx"] for r in rows], np.array([r["anomaly_score"] for r in rows])


def wave(n=4000, seed=42):
    t = np.arange(n)
    v = np.sin(2 * np.pi * t / 100)
    v[2000:2100] = np.sin(2 * np.pi * t[2000:2100] / 25)
    return v + 0.05 * np.random.default_rng(seed).normal(size=n)


@pytest.mark.parametrize("p", [Params(), Params(length=12, convolution=2, segments=6, query=20), Params(length=30, convolution=5, segments=9, query=11)])
def test_agrees_with_the_plain_method(spark, p):
    v = np.random.default_rng(7).normal(size=500)
    first, want = plain(v, p)
    at, got = ordered(detect(series(spark, v), p))
    assert at == list(range(first, first + len(want)))
    assert np.allclose(got, want, atol=1e-9)


def test_injected_anomaly_is_found_whatever_the_chunks(spark):
    v, results = wave(), []
    for chunk in (0, 300, 1111):
        at, got = ordered(detect(series(spark, v, 5), Params(chunk=chunk)))
        results.append(got)
        assert len(got) == 3827
        assert 1800 <= at[int(got.argmax())] <= 2100
    assert np.allclose(results[0], results[1], atol=1e-9) and np.allclose(results[0], results[2], atol=1e-9)


def test_fixed_numbers(spark):
    s = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").select(F.col("event_id").alias("idx"), "value")
    detector = Detector(s, Params())
    model = detector.fit()
    assert sum(len(n) for n in model.nodes) == 50 and len(model.weights) == 274 and sum(model.weights.values()) == 1343
    at, got = ordered(detector.score(model))
    assert len(got) == 827 and at[0] == 0 and int(got.argmax()) == 210
    assert got.max() == pytest.approx(0.845888, abs=1e-6) and got.min() == pytest.approx(0.105659, abs=1e-6)
    assert len(model.edge_rows()) == 274


def test_shift_and_scale_change_nothing(spark):
    v = wave(1500)
    _, a = ordered(detect(series(spark, v)))
    _, b = ordered(detect(series(spark, 3 * v - 100)))
    assert np.allclose(a, b, atol=1e-6)


def test_a_model_scores_its_own_series_as_before(spark):
    s = series(spark, wave(1500))
    detector = Detector(s, Params())
    model = detector.fit()
    _, a = ordered(detector.score(model))
    _, b = ordered(score_with(model, s))
    assert np.allclose(a, b)


def test_bad_series_are_refused(spark):
    with pytest.raises(ValueError, match="constant"):
        detect(series(spark, np.ones(500)))
    with pytest.raises(ValueError, match="short"):
        detect(series(spark, range(20)))
    with pytest.raises(ValueError, match="dense"):
        detect(series(spark, wave(500)).where("idx != 100"))
    with pytest.raises(ValueError, match="finite"):
        detect(series(spark, [float("nan"), *wave(500)]))


def test_stream_of_batches_is_scored(spark, tmp_path):
    from raywalk.streaming.frozen import score_batches

    s = series(spark, wave(1500))
    model = Detector(s, Params()).fit()
    s.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {}
    stream = spark.readStream.schema("idx long, value double").parquet(str(tmp_path / "in"))
    query = score_batches(stream, model, lambda rows, k: got.update({k: rows.count()}), checkpoint=str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert sum(got.values()) == len(ordered(score_with(model, s))[0])


@pytest.mark.parametrize("durable", [True, False])
def test_stream_gives_the_scores_of_the_whole_series(spark, tmp_path, durable):
    import os

    from raywalk.streaming.frozen import score_batches

    values = wave(2600)
    fitted = Detector(series(spark, values[:1500]), Params())
    model = fitted.fit()
    ends = fitted.ends(model)
    cuts = [0, 40, 150, 172, 173, 180, 900, 901, 2500, 2600]  # the first batches complete no score
    (tmp_path / "in").mkdir()
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        path = tmp_path / "in" / f"{k}.parquet"
        pd.DataFrame({"idx": np.arange(a, b), "value": values[a:b]}).to_parquet(path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    got = {}

    def read():
        stream = spark.readStream.schema("idx long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        seen = lambda rows, k: got.update({k: rows.toPandas()})
        query = score_batches(stream, model, seen, checkpoint=str(tmp_path / "c") if durable else None, ends=ends)
        query.processAllAvailable()
        query.stop()

    read()
    if durable:  # a second query goes on where the first one ended
        path = tmp_path / "in" / "more.parquet"
        more = wave(2700)[2600:]
        values = np.concatenate([values, more])
        pd.DataFrame({"idx": np.arange(2600, 2700), "value": more}).to_parquet(path)
        read()
    assert [len(got[k]) for k in range(4)] == [0, 0, 0, 0]
    found = pd.concat([got[k] for k in sorted(got)]).sort_values("start_idx")
    want = score_with(model, series(spark, values), ends).toPandas().sort_values("start_idx")
    assert found["start_idx"].tolist() == want["start_idx"].tolist()
    np.testing.assert_allclose(found["anomaly_score"], want["anomaly_score"], atol=1e-9)


def test_stream_with_a_gap_is_an_error(spark, tmp_path):
    from raywalk.streaming.frozen import score_batches

    model = Detector(series(spark, wave(1500)), Params()).fit()
    series(spark, wave(400)).where("idx != 200").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("idx long, value double").parquet(str(tmp_path / "in"))
    query = score_batches(stream, model, lambda rows, k: None)
    with pytest.raises(Exception, match="without a gap"):
        query.processAllAvailable()
