"""Corpus pipeline: language, quality, near duplicates, mix, tokens.

Each stage works on all documents that its predecessor kept, as written to Parquet; a stage's table is deleted when the next one is written.

Defined results, by stage: a null or empty text, or one without a letter, has no language and goes in the first stage, so later stages see
none in a run; alone, the quality classifier scores such a text by its bias, near-duplicate detection keeps it, the mix gives it no tokens, and its
ids are empty. A document without language or source counts as of language or source ''. Very long texts are worked on whole. Ties: equal
losses go to the language that sorts first, a score of 0.5 stays, and of near copies the least key stays. Equal rows are judged
alike, until of a key that is repeated one row stays, that of the least text, in near-duplicate detection; rows without key all stay. An
empty table gives empty tables. Other columns, and the input's own columns of any name, go through unchanged up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raywalk.llm import bpe, langid, mixing, near_dedup, quality, shared
from raywalk.llm.queries import AXES, TARGETS, VOCABULARY

#: Part of the tokens that the mix keeps.
PART = 0.7


def _with_own_columns(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], *made: str) -> DataFrame:
    """A stage's rows with the columns of ``docs`` as they were, also those that are named like what the stage makes."""
    own = {c: shared.free_name(docs, f"_own_{c}") for c in docs.columns if c.lower() in made}
    return stage(docs.withColumnsRenamed(own)).select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on; those with no letter, or ambiguous, go."""
    model = langid.fit(docs, F.lit(True))
    told = (F.col("lang_pred") != langid.UND) & ~F.col("ambiguous")
    return _with_own_columns(docs, lambda df: langid.identify(df, model).where(told), "lang_pred", "score", "lead", "ambiguous")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be of quality 1 go on."""
    model = quality.fit(docs, shared.read(spark, sf_dir, "labels"), F.lit(True))
    return _with_own_columns(docs, lambda df: quality.score(df, model).where("predicted = 1"), "score", "predicted")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component goes on, in one row."""
    kept = near_dedup.link(docs).where("kept").select("doc_id").distinct()
    found = docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return found
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("least"))
    return one.select(*("doc_id" if c == "doc_id" else F.col("least").getField(c).alias(c) for c in docs.columns)).union(found.where("doc_id IS NULL"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities go on."""
    axes, targets = {f"mix_{n}": f(n) for n, f in AXES.items()}, {f"mix_{n}": t for n, t in TARGETS.items()}
    return _with_own_columns(docs, lambda df: mixing.mix(df, axes, targets, PART).where("sampled"), *axes, "n_tokens", "weight", "prob", "sampled")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether these decode to the text."""
    path = public_tokenizers.path(VOCABULARY)
    done = bpe.transcode(docs, path, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Models are fitted on the way, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = shared.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = shared.write_table(stage(spark, docs, sf_dir), name)
        shared.drop_table(docs)  # the input itself is left alone
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
