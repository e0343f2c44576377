"""The queries opN_<name> over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, fingerprints, licenses, media, mixing, quality, secret_scan, sharding, simhash, token_counts
from quern.llm.common import WORD, documents, materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def whole_text():
    return F.coalesce(F.col("text"), F.lit(""))


def word_count():
    return F.regexp_count(whole_text(), F.lit(WORD)).cast("long")


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes; copies of a text stay in one range of keys, so they meet in one shard unless that overfills it."""
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(whole_text()) + 1).cast("long").alias("size"), F.crc32(whole_text()).alias("text_crc32"), F.xxhash64(whole_text()).alias("key"))
    out = sharding.shard(rows, "key", "size", "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.document_sizes(documents(spark, sf_dir), word_count())
    mixed = mixing.with_copies(sizes, mixing.plan(sizes), "source", F.col("size"), F.col("draw"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.with_lengths(documents(spark, sf_dir).select("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.context_table(materialize(token_counts.histogram(lengths)))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = media.as_sound(documents(spark, sf_dir).select("doc_id", "text"))
    return sound.select(
        "doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), media.feature().alias("feature"), F.size("codes").alias("n_pairs"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.judged(docs, documents(spark, sf_dir, "labels")).drop("text")


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


ORACLES["op2_licenses"] = licenses.oracle()


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.col("spans")
    return found.select(
        "doc_id", *[secret_scan.counted(spans, n).alias(f"n_{r.name}") for n, r in enumerate(secret_scan.BASE)],
        F.sha2(secret_scan.named(spans, most=len(secret_scan.BASE)), 256).alias("base_sha256"), secret_scan.named(spans).alias("spans"))


ORACLES["op8_secrets"] = secret_scan.oracle()


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_components(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", whole_text().alias("text"))
    paired = fingerprints.with_next(docs, "doc_id", ["text", "runs"], ["text"], {"runs": fingerprints.winnow(F.col("text")), "n_chars": F.char_length("text").cast("long")})
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    paired = paired.select("doc_id", "n_chars", "runs", F.col("next.runs").alias("next_runs"), F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut).alias("head"), F.substring("next.text", F.lit(1), cut).alias("tail"))
    edited = paired.select(
        "doc_id", "n_chars", "runs", "next_runs", F.sha2(F.concat("head", "tail"), 256).alias("edited_sha256"),
        fingerprints.winnow_replaced(F.col("runs"), F.col("head"), F.col("tail")).alias("edited_runs"))
    return edited.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.written(F.col("runs")).alias("fingerprint"), fingerprints.written(F.col("edited_runs")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("runs"), F.col("edited_runs")).alias("near_edited"), fingerprints.likeness(F.col("runs"), F.col("next_runs")).alias("near_next"))
