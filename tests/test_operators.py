"""Operators on small series worked out by hand or by plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raywalk.operators import chunks, compare, density, graph, numeric, pca, polar, scoring, windows
from raywalk.params import Params


def series(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, value double")


def column(df, order, name):
    return [r[name] for r in df.orderBy(order).collect()]


def test_params_are_checked():
    for bad in (dict(length=10, convolution=8), dict(convolution=0), dict(segments=0), dict(query=0), dict(chunk=10)):
        with pytest.raises(ValueError):
            Params(**bad)
    with pytest.raises(ValueError):
        Params().check_length(40)


def test_last_complete_sum_is_left_out(spark):
    found = column(windows.sliding_sum(series(spark, [4.4, 5.5, 6.6, 7.7]), 2), "idx", "conv")
    assert found == pytest.approx([9.9, 12.1])


@pytest.mark.parametrize("chunk", [16, 37, 1000])
def test_chunks_dont_change_windows(spark, chunk):
    v = np.random.default_rng(1).normal(size=200)
    s = series(spark, v)
    want = np.convolve(v, np.ones(16), "valid")[:-1]
    for f in (windows.sliding_sum, windows.sliding_sum_prefix):
        assert column(f(s, 16, chunk=max(chunk, 16)), "idx", "conv") == pytest.approx(want.tolist())
    rows = column(windows.lag_embedding(s, 7, "value", chunk=chunk), "idx", "row")
    assert np.allclose(rows, np.lib.stride_tricks.sliding_window_view(v, 7))
    want = np.convolve(v, np.ones(10) / 10, "valid")
    for f in (windows.running_mean, windows.running_mean_prefix):
        assert column(f(s, "value", 10, "m", chunk=chunk), "idx", "m") == pytest.approx(want.tolist())
    pairs = windows.lead_pairs(s, ["value"], chunk).orderBy("idx").collect()
    assert [r["next_value"] for r in pairs] == v[1:].tolist()


def test_frames_longer_than_chunks_are_refused(spark):
    with pytest.raises(ValueError):
        windows.sliding_sum(series(spark, range(10)), 8, chunk=4)


def test_carried_values_skip_empty_chunks(spark):
    rows = spark.createDataFrame([(c, "x" if c in (1, 5000) else None) for c in (0, 1, 2, 4095, 4096, 5000, 5001, 9000)], "chunk long, v string")
    got = dict(chunks.carried(rows, F.col("v"), []).collect())
    assert got == {0: None, 1: None, 2: "x", 4095: "x", 4096: "x", 5000: "x", 5001: "x", 9000: "x"}


def test_candidates_at_the_largest_distance_repeat_rays(spark):
    points = spark.createDataFrame([(0, 1.0, 0.1), (1, -1.0, -0.1)], "idx long, x double, y double")
    found = [r["segment"] for r in polar.candidate_rays(points, 6).orderBy("ord").collect()]
    assert len(found) == 8 and len(set(found)) == 6
    assert found == [(0 - 3 - 1 + t) % 6 for t in range(8)]


def test_origin_has_angle_zero(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, -1.0), (2, -1.0, 0.0), (3, float("nan"), 1.0)], "idx long, x double, y double")
    rows = polar.polar_buckets(points, 4).orderBy("idx").collect()
    assert [r["bucket"] for r in rows] == [0, 3, 2, 0]


def test_intersections_agree_with_numpy(spark):
    rng = np.random.default_rng(4)
    xy = rng.normal(size=(300, 2))
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "idx long, x double, y double")
    found = polar.intersections(points, 6, chunk=64).orderBy("transition", "ord").collect()
    directions = np.array([d[1:] for d in polar.ray_directions(6)])
    t, s, d = numeric.crossings(xy[:, 0], xy[:, 1], 6, math.hypot(*np.abs(xy).max(axis=0)), directions)
    assert [(r["transition"], r["segment"]) for r in found] == list(zip(t.tolist(), s.tolist()))
    assert [r["distance"] for r in found] == pytest.approx(d.tolist())


def test_density_needs_two_different_samples(spark):
    hits = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 1, 1.0), (2, 0, 1, 1.0), (3, 0, 2, 1.0), (4, 0, 2, 2.0)], "transition long, ord int, segment int, distance double")
    extent = spark.createDataFrame([(3.0,)], "extent double")
    assert {r["segment"] for r in density.density_grid(hits, extent, 10).collect()} == {2}
    assert density.local_maxima(spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 1.0, 3.0), (0, 2, 2.0, 3.0), (0, 3, 3.0, 1.0), (0, 4, 4.0, 2.0), (0, 5, 5.0, 0.0)], "segment int, u int, radius double, density double")).collect() == [(0, 0, 4.0)]


def test_matching_ties_go_to_the_lower_node_and_lone_rays_to_zero(spark):
    hits = spark.createDataFrame([(0, 0, 0, 2.0), (1, 0, 0, 2.6), (2, 0, 7, 9.0)], "transition long, ord int, segment int, distance double")
    nodes = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0)], "segment int, node int, radius double")
    assert column(graph.match_nodes(hits, nodes), "transition", "node") == [0, 1, 0]
    assert numeric.nearest(np.array([2.0, 2.6]), np.array([1.0, 3.0])).tolist() == [0, 1]
    assert numeric.nearest(np.array([5.0]), np.zeros(0)).tolist() == [0]


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_edges_walk_over_gaps(spark, chunk):
    hits = spark.createDataFrame([(2, 0, 1, 0), (2, 3, 2, 0), (5, 1, 1, 0)], "transition long, ord int, segment int, node int")
    every = spark.range(8).withColumnRenamed("id", "transition")
    found = [tuple(r) for r in graph.edge_events(hits, every, chunk).orderBy("transition", "ord").collect()]
    a, b = (1, 0), (2, 0)
    want = [(2, 3, *a, *b), (3, 0, *b, *b), (4, 0, *b, *b), (5, 1, *b, *a), (6, 0, *a, *a), (7, 0, *a, *a)]
    assert found == want
    t, x, y = numeric.edge_walk(np.array([2, 2, 5]), np.array([1, 2, 1]), 8, -1)
    assert list(zip(t, x, y)) == [(2, 1, 2), (3, 2, 2), (4, 2, 2), (5, 2, 1), (6, 1, 1), (7, 1, 1)]


def test_first_crossing_alone_makes_no_slot(spark):
    hits = spark.createDataFrame([(1, 0, 0, 0)], "transition long, ord int, segment int, node int")
    every = spark.range(4).withColumnRenamed("id", "transition")
    assert column(graph.edge_events(hits, every), "transition", "transition") == [2, 3]


def test_loops_count_twice_and_scores_divide_by_events(spark):
    events = spark.createDataFrame([(0, 0, 0, 0, 0, 0), (0, 1, 0, 0, 1, 0), (1, 0, 1, 0, 0, 0), (2, 0, 0, 0, 1, 0)], "transition long, ord int, from_segment int, from_node int, to_segment int, to_node int")
    edges = graph.edges(events)
    assert {(r[0], r[1]): r[2] for r in graph.node_degrees(edges).collect()} == {(0, 0): 4, (1, 0): 2}
    slots = {r["transition"]: (r["summands"], r["edges"]) for r in scoring.slot_summands(events).collect()}
    assert slots == {0: (3 + 6, 2), 1: (1, 1), 2: (6, 1)}
    paths = scoring.path_scores(scoring.slot_summands(events), 2)
    assert column(paths, "start_idx", "score") == pytest.approx([10 / 3, 7 / 2])
    assert tuple(graph.graph_summary(edges).first()) == (3, 4, 2)


def test_equal_scores_normalise_to_zero(spark):
    rows = spark.createDataFrame([(0, 2.0), (1, 2.0)], "start_idx long, score double")
    assert column(windows.normalised(rows, "score", "z"), "start_idx", "z") == [0.0, 0.0]


@pytest.mark.parametrize("method", ["scatter", "qr"])
def test_components_agree_with_svd(spark, method):
    v = np.random.default_rng(2).normal(size=400).cumsum()
    conv = series(spark, v).withColumnRenamed("value", "conv")
    rows = np.lib.stride_tricks.sliding_window_view(v, 8)
    means, pc = pca.principal_components(conv, 8, method=method, chunk=64)
    assert means == pytest.approx(rows.mean(axis=0))
    want = np.linalg.svd(rows - rows.mean(axis=0), full_matrices=False)[2][:3].T
    want = want * np.where(want[0] < 0, -1, 1)
    assert np.allclose(pc, want, atol=1e-6)
    assert (pc[0] >= 0).all()


def test_rotation_reaches_z():
    for ref in (np.array([1.0, 2.0, 3.0]), np.array([0.0, 0.0, 2.0]), np.array([0.0, 0.0, -2.0]), np.array([3.0, -1.0, 0.0])):
        r = numeric.rotation_to_z(ref)
        assert np.allclose(r @ ref / np.linalg.norm(ref), [0, 0, 1]) and np.allclose(r @ r.T, np.eye(3))
    with pytest.raises(ValueError):
        numeric.rotation_to_z(np.zeros(3))


def test_differences_tell_what_is_missing(spark):
    a, b = (spark.createDataFrame(r, "start_idx long, anomaly_score double") for r in ([(0, 1.0), (1, 2.0), (2, 5.0)], [(1, 2.5), (2, 5.0), (3, 0.0)]))
    assert compare.score_diff(a, b).first().asDict() == {"compared": 2, "max_difference": 0.5, "avg_difference": 0.25, "only_left": 1, "only_right": 1}


def test_frames_added_up_anew_equal_running_sums():
    from raywalk.operators import numeric

    values = np.random.default_rng(5).normal(size=5000).cumsum()
    for length in (1, 7, 5000, 5001):
        np.testing.assert_allclose(numeric.frame_sums(values, length, block=64), numeric.moving(values, length), atol=1e-7)
        np.testing.assert_allclose(numeric.frame_sums(values, length), numeric.sliding_sums(values, length), atol=1e-7)


def test_memory_of_a_chunk_is_bounded():
    import tracemalloc

    x, y = np.random.default_rng(5).normal(size=(2, 100_001))
    directions = np.array([d[1:] for d in polar.ray_directions(50)])
    whole = numeric.crossings(x, y, 50, 7.0, directions, block=1 << 20)
    for block in (7_919, 100_000):
        assert all(np.array_equal(a, b) for a, b in zip(whole, numeric.crossings(x, y, 50, 7.0, directions, block)))
    peaks = []
    for n in (100_001, 200_001):
        x, y = np.random.default_rng(5).normal(size=(2, n))
        tracemalloc.start()
        found = numeric.crossings(x, y, 50, 7.0, directions)
        peaks.append(tracemalloc.get_traced_memory()[1] - 2 * sum(a.nbytes for a in found))
        tracemalloc.stop()
    assert max(peaks) < 160e6 and peaks[1] < 1.3 * peaks[0]
    assert Params().chunk_for(10**10, 12) <= 1 << 17 and Params(length=300_000, convolution=16).chunk_for(10**10, 12) > 600_000


def test_density_terms_that_are_zero_are_not_worked_out(monkeypatch):
    d, points, done, exp = np.random.default_rng(7).uniform(0, 6, 5000), np.arange(250) * 6 / 250, [], np.exp
    want = exp(-0.5 * ((d[:, None] - points) * 40.0) ** 2).sum(axis=0)
    monkeypatch.setattr(np, "exp", lambda a, **k: done.append(a.size) or exp(a, **k))
    assert np.allclose(numeric.density_sums(d, points, 40.0), want, rtol=1e-12, atol=0)
    assert sum(done) < 0.5 * d.size * points.size
    assert not numeric.density_sums(d[:0], points, 40.0).any()
