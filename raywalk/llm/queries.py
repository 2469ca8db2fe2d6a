"""Queries over the whole driver tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raywalk.llm import bpe, langid, lm, mixing, mtree, near_dedup, quality, shared, tiff, urls, warc

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

URL_RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]


def op1_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products among all vectors for every vector whose id is divisible by 50."""
    vectors = shared.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return mtree.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text; count and digest both."""
    path = public_tokenizers.path(VOCABULARY)
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.transcode(docs, path, public_tokenizers.PATTERN).drop("text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text; a third of the keys is held out."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = shared.fold("doc_id", 3) == 1
    model = quality.fit(docs, shared.read(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard index of 0.8 or more."""
    return near_dedup.link(shared.read(spark, sf_dir, "documents").select("doc_id", "text"), params=near_dedup.Params(words=4))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL by the fixed rules."""
    return urls.judge(shared.read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, index the captures, look every page's URL up and read the records back by range."""
    pages = shared.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = shared.new_path(spark, "warc")
    captures = warc.write_archives(pages, path)
    found = warc.lookup(warc.build_index(captures, path), captures)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)")
    return warc.read_records(found, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: What each axis is raked to, and the part of all tokens that is drawn.
AXES = {"source": F.col, "lang": F.col, "topic": lambda _: mixing.text_form(F.col("text"))}
TARGETS = {"source": mixing.uniform, "lang": mixing.square_root, "topic": mixing.square_root}
PART = 0.5


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rake all documents to even sources and flattened languages and topics, and draw half of the tokens."""
    docs = shared.read(spark, sf_dir, "documents")
    thin = docs.select("doc_id", *(f(n).alias(n) for n, f in AXES.items()), mixing.n_words(F.col("text")).alias("words"))
    thin = shared.write_table(thin, "mixing")
    mixed = mixing.mix(thin, {n: F.col(n) for n in AXES}, TARGETS, PART, F.col("words"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("prob", 6).alias("prob"), "sampled")


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every whole text as TIFF, read it back and digest it."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    return tiff.payload_digests(tiff.encode_texts(docs).drop("text"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text with the smoothed word counts and the model; a seventh of the keys is held out."""
    held_out = shared.fold("doc_id", 7) == 2
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return lm.score(docs, lm.fit(docs, ~docs["held_out"]))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every whole text; a quarter of the keys is held out."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = shared.fold("doc_id", 4) == 2
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mtree": op1_mtree,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_near_dedup": op4_near_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_tiff": op8_tiff,
    "op9_lm": op9_lm,
    "op10_langid": op10_langid,
}

_PARTED = r"""
parted AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages)
"""

_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+')"


def near_dedup_sql(table: str, k: int) -> str:
    """CTEs ``sizes`` (doc_id, n_shingles) and ``grouped`` (doc_id, component_id) for documents of ``table``."""
    return f"""
worded AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM {table}),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= {k} THEN [array_to_string(words[i:i + {k - 1}], ' ') for i in range(1, len(words) - {k} + 2)]
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s
  FROM worded),
sizes AS MATERIALIZED (
  SELECT w.doc_id, coalesce(n, 0) AS n_shingles
  FROM worded w LEFT JOIN (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id) c ON w.doc_id = c.doc_id),
common AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * n >= 80 * (x.n_shingles + y.n_shingles - n)),
ways AS MATERIALIZED (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT r.doc_id, w.b FROM reached r JOIN ways w ON r.other = w.a),
grouped AS MATERIALIZED (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
"""




def mixing_sql(rounds: int, part: float) -> str:
    """The raking rounds, unrolled: each axis of each round scales the cells by target over sum."""
    steps, last = [], "w0"
    for r in range(rounds):
        for axis in ("source", "lang", "topic"):
            name = f"w{r}_{axis}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, CASE WHEN h.have > 0 THEN c.w * (t.share * a.total / h.have) ELSE 0 END AS w "
                f"FROM {last} c JOIN (SELECT {axis} AS v, sum(w) AS have FROM {last} GROUP BY 1) h ON c.{axis} = h.v JOIN target t ON t.axis = '{axis}' AND t.v = c.{axis}, totals a)"
            )
            last = name
    return f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
formed AS MATERIALIZED (
  SELECT doc_id, source, lang,
         CASE WHEN d > 0 AND 50 * d >= length(t) THEN 'data' WHEN length(t) < 120 * l THEN 'lines' ELSE 'prose' END AS topic, n_tokens
  FROM (SELECT *, length(t) - length(translate(t, '0123456789', '')) AS d, length(t) - length(translate(t, chr(10), '')) + 1 AS l,
               CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM docs)),
w0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS w FROM formed GROUP BY 1, 2, 3),
totals AS MATERIALIZED (SELECT CAST(sum(tokens) AS DOUBLE) AS total FROM w0),
wanted AS MATERIALIZED (
  SELECT 'source' AS axis, source AS v, CASE WHEN sum(tokens) > 0 THEN 1.0::DOUBLE ELSE 0 END AS x FROM w0 GROUP BY 2
  UNION ALL SELECT 'lang', lang, sqrt(CAST(sum(tokens) AS DOUBLE)) FROM w0 GROUP BY 2
  UNION ALL SELECT 'topic', topic, sqrt(CAST(sum(tokens) AS DOUBLE)) FROM w0 GROUP BY 2),
target AS MATERIALIZED (SELECT axis, v, x / sum(x) OVER (PARTITION BY axis) AS share FROM wanted),
{", ".join(steps)},
weighted AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN w / tokens ELSE 1 END AS weight FROM {last}),
ordered AS MATERIALIZED (
  SELECT *, coalesce(sum(tokens) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
         sum(tokens * weight) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighted),
scaled AS MATERIALIZED (
  SELECT ({part} * total - cut) / rest AS c FROM ordered, totals
  WHERE rest > 0 AND ({part} * total - cut) / rest * weight <= 1 ORDER BY weight DESC, source, lang, topic LIMIT 1)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(weight, 6) AS weight, round(least(1.0, c * weight), 6) AS prob,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < least(1.0, c * weight) AS sampled
FROM formed d JOIN weighted w ON d.source = w.source AND d.lang = w.lang AND d.topic = w.topic, scaled
"""


ORACLE_SQL: dict[str, str] = {
    "op7_mixing": mixing_sql(mixing.ROUNDS, PART),
    "op6_warc": """
WITH hashed AS MATERIALIZED (
  SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
firsts AS (SELECT s, max(page_id) AS first FROM hashed GROUP BY s)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM hashed JOIN firsts USING (s)
""",
    "op1_mtree": """
WITH vectors AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors x ON q.vec_id % 50 = 0 AND q.vec_id != x.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY rank <= 5
""",
    "op4_near_dedup": f"""
WITH RECURSIVE {near_dedup_sql("documents", 4).strip()}
SELECT s.doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM sizes s JOIN grouped g ON s.doc_id = g.doc_id
""",
    "op5_url_filters": f"""
WITH {_PARTED.strip()},
rules(verdict, rhost, rpath) AS (VALUES {_RULES}),
fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS place
  FROM parted JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parted p LEFT JOIN fits f ON p.page_id = f.page_id AND f.place = 1
""",
}
