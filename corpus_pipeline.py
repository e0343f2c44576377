"""From documents to token ids in five stages, each over all that the one before it kept.

Each function takes (spark, docs, sf_dir). All but the last return the columns
of documents; rows with nulls, empty texts and repeated rows go through as the
operators state, and no rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, mixing, quality, secret_scan, simhash
from quern.llm.common import WORD, documents, fresh, materialize, release, scope

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def beside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` without columns of these names, which an operator gives its own, and what to select to have them back."""
    taken = {n.lower() for n in names}
    other = [fresh(docs, c) if c.lower() in taken else c for c in docs.columns]
    return docs.toDF(*other), [F.col(f"`{o}`").alias(c) for o, c in zip(other, docs.columns, strict=True)]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best grade is likely enough; the model learns from the labelled ones among them."""
    docs, back = beside(docs, "keep", "expected_grade", "tail_probability")
    return quality.judged(docs, documents(spark, sf_dir, "labels")).where("keep").select(*back)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, likeness 0.8 or more."""
    return simhash.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    docs, back = beside(docs, "spans")
    found = secret_scan.scan(docs)
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*back)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs, F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each document that the mix holds, repeats as rows."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), TOKENIZER)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality_stage), ("near_dedup", dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]
#: Learned weights, SimHash components and BPE have no SQL: tests hold each stage against plain computations over its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each one's result is written before the next reads it, and goes when that is written."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        with scope() as keep:
            after = keep(materialize(stage(spark, docs, sf_dir)))
        release(docs)
        docs = after
    return docs
