"""Corpus preparation: language ID, near-dedup, suffix-array dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the
columns of documents; the last returns the tokens of each mixed document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, langid, minhash, mixing, suffixes
from lexmill.llm.queries import vocabulary_path
from lexmill.llm.scratch import Scratch, read_table

#: A prediction as sure as this replaces another language that a document claims.
SURE = 0.99
#: Per cent of common shingles, of all of two texts, that makes them near-duplicates.
NEAR_PERCENT = 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those of no learned language; fills and corrects ``lang``.

    The least score of a clear prediction follows from held-out rows.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    least = langid.least_score(docs, model)
    found = langid.identify(docs, model, keep=tuple(docs.columns), with_text=True, names=("__lang", "__score"))
    clear = found.filter((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= least))
    lang = F.when(F.col("lang").isNull() | (F.col("__score") >= SURE), F.col("__lang")).otherwise(F.col("lang"))
    return clear.withColumn("lang", lang).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, and one row of each doc_id."""
    return minhash.drop_duplicates(docs, Scratch(spark, "minhash"), NEAR_PERCENT)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that an earlier document, or the same one, holds already."""
    return suffixes.deduplicate(docs, Scratch(spark, "suffixes"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's target weight asks for."""
    return mixing.mix(docs, Scratch(spark, "mixing"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, ids_sha256 and decoded_sha256 of each mixed document."""
    return bpe.encode(spark, docs, vocabulary_path(), keep=("doc_id", "source"), outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", language_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", suffix_stage),
    ("source_mixing", mixing_stage),
    ("bpe_encoding", token_stage),
]

#: SQL has no equivalent of these stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, str(k))
    return docs
