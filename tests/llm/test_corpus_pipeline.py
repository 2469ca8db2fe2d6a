"""The corpus pipeline: each stage on what its predecessor kept."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from raywalk.llm import bpe, near_dedup, queries, shared

SF = "/root/testdata/sf0.01"


def test_stages_in_order(spark):
    docs = shared.read(spark, SF, "documents")
    columns, kept = docs.columns, docs.count()
    whole = {r["doc_id"]: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "near_duplicates", "source_mix", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = shared.write_table(stage(spark, docs, SF), f"test-{name}")
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= before and out.count() == len(ids)
        if name == "language_id":
            assert len(ids) > 0.98 * kept
        elif name == "quality_classifier":
            labels = {r["doc_id"]: r["quality"] for r in shared.read(spark, SF, "labels").collect()}
            good, bad = ([i for i in before if labels.get(i) == q] for q in (1, 0))
            assert sum(i in ids for i in good) > 0.97 * len(good) and sum(i in ids for i in bad) < 0.1 * len(bad)
        elif name == "near_duplicates":
            linked = near_dedup.link(docs).collect()
            assert ids == {r["component_id"] for r in linked}
        elif name == "source_mix":
            assert 0 < len(ids) < len(before)
        if name == "byte_bpe":
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(queries.VOCABULARY)), special_tokens={})
            for r in out.collect():
                assert r["round_trip"] and r["ids"] == library.encode_ordinary(whole[r["doc_id"]]["text"]) and r["n_tokens"] == len(r["ids"])
        else:
            assert out.columns == columns
        docs = out
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == ids


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and keys, clashing columns, no rows at all."""
    from pyspark.sql import functions as F

    docs = shared.read(spark, SF, "documents").limit(300)
    clash = {"score": 1.5, "weight": 2.5, "predicted": 7, "lead": 3, "sampled": False, "n_tokens": 9, "_letter": "own", "mix_topic": "own", "ids": 4, "least": 5}
    given = docs.withColumns({c: F.lit(v) for c, v in clash.items()})
    one = given.where("length(text) > 200").orderBy("doc_id").limit(1)
    text = one.first()["text"]
    odd = one.withColumn("doc_id", F.lit(-1).cast("long")).union(one.withColumn("doc_id", F.lit(None).cast("long"))).union(one.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(-2).cast("long")))
    odd = odd.union(one.withColumn("text", F.lit("")).withColumn("doc_id", F.lit(-3).cast("long"))).union(one.withColumn("text", F.lit(" ".join([text] * (1_500_000 // len(text))))).withColumn("doc_id", F.lit(-4).cast("long")))
    odd = odd.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    given = shared.write_table(given.union(given.limit(40)).union(odd), "test-odd")
    for name, stage in corpus_pipeline.STAGES:
        out = shared.write_table(stage(spark, given, SF), f"test-odd-{name}")
        assert stage(spark, given.limit(0), SF).count() == 0
        if name == "byte_bpe":
            assert out.count() == given.count() and out.where("NOT round_trip").count() == 0
            assert {r["n_tokens"] for r in out.where("doc_id IN (-2, -3)").collect()} == {0}
            continue
        assert out.columns == given.columns and out.exceptAll(given).count() == 0
        found = [r["doc_id"] for r in out.select("doc_id").collect()]
        if name == "language_id":
            assert not {-2, -3} & set(found) and {-1, -4, None} <= set(found)
        if name == "near_duplicates":
            assert len(found) == len(set(found)) and {-2, -3, -4, None} <= set(found) and -1 not in found  # the long text has the shingles of the short one
    whole = given.where("doc_id IS NULL OR doc_id >= -1")
    assert corpus_pipeline.near_duplicates(spark, whole, SF).where(F.col("text") == text).count() == 2
