"""Search, near duplicates, URLs, archives, mixing and media against brute force, and their edge cases."""

import base64
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from raywalk.llm import components, mixing, mtree, near_dedup, queries, tiff, urls, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(frame):
    return sorted(repr(tuple(None if x is None or x != x else x for x in r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = tables.execute(queries.ORACLE_SQL[name]).df()
    got, want = (f.astype(object).where(f.notna(), None) for f in (got, want))
    assert rows(got) == rows(want)


# M-tree


def best(ids, v, q, own, k):
    order = sorted((-sum(int(a) * int(b) for a, b in zip(v[i], q)), ids[i]) for i in range(len(ids)) if ids[i] != own)
    return [(i, -s) for s, i in order[:k]]


def searched(tree, queries, own, k, floors=None):
    search = mtree.Search(tree.pages, tree.centre, tree.norm)
    return [list(zip(i.tolist(), s)) for i, s in search.best(queries, own, k, floors)], search.computed


@pytest.mark.parametrize("leaf, fanout", [(4, 3), (16, 5)])
@pytest.mark.parametrize("unit", [1.0, 2.0**24])
def test_tree_search_is_exact(leaf, fanout, unit):
    rng = np.random.default_rng(5)
    v = np.floor(np.concatenate([rng.normal(size=(150, 6)) * 20, rng.normal(size=(5, 6)).repeat(30, axis=0) * 30, np.zeros((10, 6))]) * unit)
    ids = rng.permutation(len(v)) * 3
    tree = mtree.MTree(ids, v, leaf, fanout)
    assert all(len(p[1]) <= max(leaf, fanout) for p in tree.pages)
    some = np.arange(0, len(v), 7)
    want = [best(ids, v, v[i], ids[i], 5) for i in some]
    assert searched(tree, v[some], ids[some], 5)[0] == want
    floors = [w[2][1] for w in want]
    assert searched(tree, v[some], ids[some], 5, floors)[0] == [[x for x in w if x[1] >= f] for w, f in zip(want, floors)]


def test_tree_saves_computations():
    rng = np.random.default_rng(6)
    v = np.floor((rng.normal(size=(20, 4)) * 200).repeat(100, axis=0) + rng.normal(size=(2000, 4)))
    tree = mtree.MTree(np.arange(2000), v, 32, 8)
    assert sum(searched(tree, v[i * 100 : i * 100 + 1], np.array([-1]), 5)[1] for i in range(20)) < 20 * 2000 / 2


def test_scores_beyond_float_are_whole_numbers(spark):
    big = 2.0**28 / 256
    data = [(50, [big, 7 / 256, 0.0]), (1, [big, 1 / 256, 0.0]), (2, [big, 0.0, 0.0]), (100, [2.0**60, 0.0, -1.0]), (3, [2.0**60, 0.0, 0.0]), (4, [1e307, 0.0, 0.0]), (5, [-1e200, 1.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for rows in (2, 100):
        got = {(r["query_id"], r["vec_id"]): r["score"] for r in mtree.top_k(df, F.col("vec_id") % 50 == 0, k=9, tree_rows=rows).collect()}
        assert got[50, 1] == 2**56 + 7 == 72057594037927943 and got[50, 2] == 2**56
        assert got[100, 3] == mtree.MOST and got[100, 5] == mtree.LEAST and not any(4 in x for x in got) == ("inf" in str(1e307 * 256))


def test_top_k_by_brute_force_over_many_trees(spark):
    rng = np.random.default_rng(12)
    v = np.concatenate([rng.normal(size=(30, 5)).repeat(20, axis=0) + rng.normal(size=(600, 5)) * 0.01, np.ones((300, 5))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    count = spark.sparkContext.accumulator(0)
    got = {}
    for r in mtree.top_k(df, F.col("vec_id") % 50 == 0, tree_rows=60, leaf=8, fanout=4, counted=count).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = np.floor(v * 256)
    assert got == {i: best(list(range(900)), whole, whole[i], i, 5) for i in range(0, 900, 50)}
    assert count.value < 18 * 900 * 0.6


def test_text_keys_and_clashing_names(spark):
    df = spark.createDataFrame([("a", [1.0], 1, 2, "x"), ("b", [2.0], 1, 2, "x"), ("b", [3.0], 1, 2, "x"), ("c", [0.5], 1, 2, "x")], "vec_id string, embedding array<double>, id int, v int, tree string")
    got = mtree.top_k(df, F.col("vec_id") == "b", k=2, tree_rows=2).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [("b", 1, "a", 256 * 512), ("b", 2, "c", 128 * 512)]


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (51, [1.0, 0.0]), (52, [0.5, 0.5]), (53, None), (54, [nan, 1.0]), (55, [inf, 1.0]), (56, [None, 1.0]), (100, [nan, 0.0]), (None, [1.0, 1.0]), (57, [1.0]), (57, [1.0]), (58, [])]
    df = spark.createDataFrame([(i, v, 9) for i, v in data], "vec_id long, embedding array<double>, score int")
    got = mtree.top_k(df, F.col("vec_id") % 50 == 0, tree_rows=2)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    top = 256 * 256
    assert by[0] == [(1, 50, top), (2, 51, top), (3, 57, top), (4, 57, top), (5, 52, top // 2)]
    assert set(by) == {0, 50}
    few = mtree.top_k(df.where("vec_id IN (0, 52)"), F.col("vec_id") % 50 == 0)
    assert [tuple(r) for r in few.collect()] == [(0, 1, 52, top // 2)]
    assert mtree.top_k(df.limit(0), F.lit(True)).count() == 0


# near duplicates


def brute(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_copies_by_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts, base = [], [list(rng.choice(words, n)) for n in (12, 40, 40, 90)]
    head = "one common line that opens very many texts here".split()
    for i in range(260):
        w = list(base[i % 4])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = str(rng.choice(words))
        texts.append((i, " ".join((head if i % 3 == 0 else []) + w)))
    texts += [(300 + i, texts[5][1].upper()) for i in range(20)] + [(400, None), (401, ""), (402, " \t\n"), (403, "a b"), (404, "A  B"), (405, "a b c")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute(texts, 4, 80)
    # few rows and small blocks: pivots settle little, blocks must
    for p in (near_dedup.Params(4), near_dedup.Params(4, bands=60, rows=2, block=8)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.link(df, params=p).collect()}
        assert got == want
    kept = {r["doc_id"] for r in near_dedup.link(df, params=p).where("kept").collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_near_dedup_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (None, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (3, None, "x")], "doc_id long, text string, kept string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in near_dedup.link(df).collect())
    assert got == [("1", 3, "1", True), ("1", 3, "1", True), ("2", 3, "1", False), ("3", 0, "3", True), ("None", 3, "None", True)]
    assert near_dedup.link(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5), (7, None), (41, 40), (0, 1)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(components.components(df).collect())
    assert got == {**dict.fromkeys(range(42), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys((200, 201, 202), 200)}
    assert components.components(df.limit(0)).count() == 0


# URLs


def test_longest_rule_wins(spark):
    rules = [urls.Rule("block", "com"), urls.Rule("allow", "a.com", "/x/y"), urls.Rule("block", "a.com", "/x/yz/"), urls.Rule("allow", "b.a.com"), urls.Rule("block", "t.org", "/p"), urls.Rule("allow", "t.org", "/p")]
    cases = {
        "http://A.com/x/y1?q": ("a.com/x/y", "allow"), "http://a.com/x/yz/k#f": ("a.com/x/yz/", "block"), "http://a.com/x/yz": ("a.com/x/y", "allow"), "http://a.com/z": ("com", "block"),
        "https://c.b.a.com/x/yz/": ("b.a.com", "allow"), "http://xa.com": ("com", "block"), "http://com": ("com", "block"), "http://com.de/": (None, "allow"), "http://t.org/pq": ("t.org/p", "block"),
        "no url": (None, "allow"), None: (None, "allow"), "": (None, "allow"), "http://?x": (None, "allow"), "x\ny://a.com/x/y\n": ("a.com/x/y", "allow"), "http://a.com.": (None, "allow"),
    }
    df = spark.createDataFrame([(u, "old") for u in cases] + [(None, "old")], "url string, verdict string")
    got = urls.judge(df, rules).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r["rule"], r["verdict"]) == cases[r["url"]], r
    assert {(r["host"], r["path"]) for r in got if r["url"] in (None, "no url")} == {("", "")}
    assert urls.judge(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge(df, [], default="block").collect()} == {"block"}


# archives


def test_archive_round_trip_and_lookup(spark, tmp_path):
    data = [(1, "http://a.com/x?q#f", "<p>é</p>"), (2, "http://b.a.com/", "same\r\n\r\n"), (3, "http://a.com/x?q", "same\r\n\r\n"), (3, "http://a.com/x?q", "same\r\n\r\n"), (4, None, None), (5, "no url", ""), (None, "http://z.org/\r\nX: y", "alone"), (9, "http://big.org/", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, file string")
    path = f"file://{tmp_path}/warc"
    captures = warc.write_archives(df, path)
    assert captures.count() == len(data)
    index = warc.build_index(captures, path, block_lines=2)
    assert len(index.directory) == 4
    got = warc.read_records(warc.lookup(index, captures), path).collect()
    assert len(got) == len(data)
    by = {r["record_id"]: r for r in got}
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    for i, _, html in data:
        r = by[f"urn:page:{'null' if i is None else i}"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len((html or "").encode()), digest(html))
    kinds = {k: (r["record_type"], r["refers_to"]) for k, r in by.items()}
    assert kinds["urn:page:2"] == ("revisit", "urn:page:3") and kinds["urn:page:3"] == ("response", None) and kinds["urn:page:4"] == ("revisit", "urn:page:5")
    asked = spark.createDataFrame([("com,a)/x?q",), ("com,nowhere)/",), (None,), ("com,a)/x?q",)], "surt string")
    assert sorted(r["uri"] for r in warc.read_records(warc.lookup(index, asked), path).collect()) == ["http://a.com/x?q", "http://a.com/x?q", "http://a.com/x?q#f"]
    large = warc.write_archives(df, path, min_bytes=100)
    assert {r["record_type"] for r in large.collect()} == {"response"}
    none = warc.write_archives(df.limit(0), path)
    assert none.count() == 0 and warc.lookup(warc.build_index(none, path), asked).count() == 0


def test_revisits_by_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op6_warc(spark, SF).collect()}
    first = {}
    for p in pages:
        first[p["html"]] = max(first.get(p["html"], -1), p["page_id"])
    for p in pages:
        r, top = got[p["page_id"]], first[p["html"]]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top == p["page_id"] else ("revisit", top))


# mixing


def test_raking_meets_its_targets():
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 4, 60), rng.integers(0, 3, 60)
    tokens = rng.integers(1, 500, 60)
    shares = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25])]
    w = mixing.rake(tokens, [a, b], shares, 200)
    for of, share in zip((a, b), shares):
        assert np.allclose(np.bincount(of, weights=w) / w.sum(), share, atol=1e-6)
    weight = w / tokens
    for part in (0.05, 0.5, 0.95):
        c = mixing.calibrate(tokens, weight, part)
        assert (tokens * np.minimum(1, c * weight)).sum() == pytest.approx(part * tokens.sum())


def test_mixing_of_more_cells_than_the_driver_takes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"s{int(rng.integers(6))}", f"t{int(rng.integers(4))}", int(rng.integers(1, 50)) ** 2) for i in range(400)]
    rows += [(400, "s0", "t9", 0), (401, "s9", "t9", 0), (402, "s1", "t0", 0), (None, None, "t1", 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, topic string, words long")
    axes = {"source": F.col("source"), "topic": F.col("topic")}
    for targets in ({"source": mixing.uniform, "topic": mixing.square_root}, {"source": lambda t: {"s1": 3.0, "s2": 1.0}, "topic": mixing.uniform}):
        for part in (0.4, 1.0):
            near, far = (mixing.mix(df, axes, targets, part, F.col("words"), rounds=4, max_cells=m).orderBy("doc_id").collect() for m in (1000, 5))
            assert [r["sampled"] for r in near] == [r["sampled"] for r in far]
            for c in ("weight", "prob"):
                assert np.allclose([r[c] for r in near], [r[c] for r in far], rtol=1e-9, atol=0)


def test_mixing_edges(spark):
    rows = [(1, "a b", None, 1), (2, None, "s", 1), (2, None, "s", 1), (None, "a b c 1 2 3", "t", 1), (3, "", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight int")
    axes = {"source": F.col("source"), "topic": mixing.text_form(F.col("text"))}
    got = mixing.mix(df, axes, {"source": mixing.uniform, "topic": mixing.square_root}, 1.0).collect()
    assert len(got) == 5 and {r["source"] for r in got} == {"", "s", "t"}
    assert all(r["sampled"] for r in got if r["n_tokens"])
    assert mixing.mix(df.limit(0), axes, {"source": mixing.uniform, "topic": mixing.uniform}, 0.5).count() == 0


# media


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor, tile", [(1, 0), (2, 0), (1, 16), (2, 32)])
def test_pages_come_back(compression, predictor, tile):
    rng = np.random.default_rng(10)
    pages = [rng.integers(0, 256, (70, 33), dtype=np.uint8), np.repeat(rng.integers(0, 3, (40, 9), dtype=np.uint8), 7, axis=1), np.zeros((1, 1), np.uint8), rng.integers(0, 4, (300, 64), dtype=np.uint8)]
    data = tiff.write_tiff(pages, compression, predictor, tile, strip_rows=16)
    found = list(tiff.read_pages(data))
    assert [p.index for p in found] == [0, 1, 2, 3]
    for p, want in zip(found, pages):
        assert (p.pixels[:, :, 0] == want).all() and p.tiled == bool(tile) and p.compression == compression


def test_packers_are_lossless():
    rng = np.random.default_rng(11)
    for n in (0, 1, 2, 127, 128, 129, 130, 257, 5000, 70_000):
        for data in (bytes(n), rng.integers(0, 256, n, dtype=np.uint8).tobytes(), rng.integers(0, 2, n, dtype=np.uint8).tobytes()):
            assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data
            assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data


def test_big_endian_planar_and_16_bits():
    import struct

    a = np.arange(12).reshape(3, 4) * 1000
    planes = [a.astype(">u2"), (a + 1).astype(">u2")]
    body = b"".join(p.tobytes() for p in planes)
    fields = [(256, 4, 1, 4), (257, 4, 1, 3), (258, 3, 2, (16, 16)), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 2, 200), (277, 3, 1, 2), (278, 4, 1, 3), (279, 4, 2, 208), (284, 3, 1, 2)]
    out = bytearray(b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", len(fields)))
    for tag, kind, n, value in fields:
        raw = struct.pack(">HH", *value) if isinstance(value, tuple) else struct.pack(">I", value) if kind == 4 else struct.pack(">HH", value, 0)
        out += struct.pack(">HHI", tag, kind, n) + raw
    out += bytes(4)
    out = out.ljust(200, b"\0") + struct.pack(">II", 216, 216 + 24) + struct.pack(">II", 24, 24) + body
    (page,) = tiff.read_pages(bytes(out))
    assert (page.pixels[:, :, 0] == a).all() and (page.pixels[:, :, 1] == a + 1).all()


def test_media_query_by_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op8_tiff(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw, r = (d["text"] or "").encode(), got[d["doc_id"]]
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        media = tiff.store(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(media))
        assert (r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media).hexdigest())
        bins = [sum(x // 16 == k for x in payload) for k in range(16)]
        mean, square = sum(payload) * 1000 // len(payload), sum(x * x for x in payload) * 1000 // len(payload)
        codec = ("packbits", "lzw", "deflate", "none", "deflate", "packbits", "deflate", "none")[zlib.crc32(payload) % 8]
        pages = -(-len(payload) // (64 * tiff.PAGE_ROWS))
        assert r["feature"] == f"pages={pages};size=64x{len(payload) // 64};{codec};mean={mean};square={square};bin={bins.index(max(bins))}"


def test_every_codec_meets_texts_of_every_length():
    rng = np.random.default_rng(14)
    for size in (64, 4096, 70_016):
        met = set()
        for _ in range(80):
            payload = rng.integers(97, 101, size, dtype=np.uint8).tobytes()
            (page,) = tiff.read_pages(tiff.store(payload))
            assert page.bytes() == payload
            met.add((page.compression, page.predictor, page.tiled))
        assert met == {(c, p, t) for c in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE) for p in (1, 2) for t in (False, True) if p == 1 or c in (tiff.LZW, tiff.DEFLATE)}


def test_short_strips_and_wild_claims_are_errors(spark):
    page = np.arange(12, dtype=np.uint8).reshape(1, 12)
    plain = tiff.write_tiff([page], tiff.NONE)
    tag = lambda data, number: next(i for i in range(8, len(data) - 12) if data[i : i + 2] == number.to_bytes(2, "little") and data[i + 2] in (3, 4) and data[i + 3] == 0)

    def changed(data, number, value=None, kind=None):
        out, at = bytearray(data), tag(data, number)
        if kind:
            out[at + 2 : at + 4] = kind.to_bytes(2, "little")
        if value is not None:
            out[at + 8 : at + 12] = value.to_bytes(4, "little")
        return bytes(out)

    tiles = tiff.write_tiff([np.zeros((32, 32), np.uint8)], tiff.DEFLATE, tile=32)
    bad = [changed(plain, 279, 5), changed(plain, 256, kind=11), changed(changed(tiles, 322, 1 << 25), 323, 1 << 25), changed(changed(tiles, 256, 1 << 15), 257, 1 << 15), changed(plain, 278, 0), changed(plain, 257, 0)]
    bad += [tiff.write_tiff([np.zeros((99, 64), np.uint8)], c)[:-150] for c in (tiff.LZW, tiff.PACKBITS)]
    df = spark.createDataFrame(list(enumerate([*bad, plain])), "id int, media binary")
    got = {r["id"]: r for r in tiff.pages(df).collect()}
    assert len(got) == len(bad) + 1 and bytes(got[len(bad)]["pixels"]) == page.tobytes()
    assert all(got[i]["error"] and got[i]["pixels"] is None for i in range(len(bad)))
    with pytest.raises(Exception, match="of 12 bytes"):
        tiff.payload_digests(df.where("id = 0")).collect()


def test_mutated_media_never_fail_the_reader():
    rng = np.random.default_rng(13)
    some = [tiff.write_tiff([rng.integers(0, 5, (40, 50), dtype=np.uint8)], c, p, t) for c in tiff.NAMES for p, t in ((1, 0), (2, 16))]
    for _ in range(3000):
        data = bytearray(some[int(rng.integers(len(some)))])
        for _ in range(int(rng.integers(1, 5))):
            data[int(rng.integers(4, len(data)) if rng.random() < 0.3 else rng.integers(max(4, len(data) - 220), len(data)))] = int(rng.integers(256))
        for row in tiff._read_all(bytes(data)):
            assert (row[-1] is None) == (row[7] is not None)


def test_media_edges(spark):
    good = tiff.store(bytes(range(64)))
    loop = bytearray(good)
    loop[-4:] = loop[4:8]
    data = [(1, None), (2, b""), (3, b"GIF89a.."), (4, good), (4, good), (5, good[:40]), (6, bytes(loop)), (7, good[:-4])]
    df = spark.createDataFrame(data, "id long, media binary").withColumn("page", F.lit("old"))
    rows = tiff.pages(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {3, 4, 5, 6, 7} and len(by[4]) == 2 and all(bytes(r["pixels"]) == bytes(range(64)) for r in by[4])
    assert by[3][0]["error"] and by[5][0]["error"] and by[7][0]["error"] and [bool(r["error"]) for r in by[6]] == [False, True]
    texts = spark.createDataFrame([(1, None, 1, 2), (2, "", 1, 2), (3, "x" * 400_000, 1, 2), (3, "x" * 400_000, 1, 2), (None, "yz" * 2_000_000, 1, 2)], "doc_id long, text string, whole int, page int")
    got = tiff.payload_digests(tiff.encode_texts(texts).drop("text")).collect()
    assert sorted((r["n_bytes"], r["payload_bytes"], r["whole"], r["page"]) for r in got) == [(0, 64, 1, 2)] * 2 + [(400_000, 400_000, 1, 2)] * 2 + [(4_000_000, 4_000_000, 1, 2)]
    assert len(list(tiff.read_pages(tiff.store(b"x" * 400_000)))) == 2
    assert tiff.pages(df.limit(0)).count() == 0
