"""The driver's tables as DataFrames and temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one Parquet table; the planner prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def extremes(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row, least_c and greatest_c of each column, from the files' footers where they hold them: no data page is read.

    Whole numbers, dates and floats have theirs there; Spark reads other
    columns. The settings that this needs hold for this scan alone, except
    that pushing aggregates into footers stays on in the session.
    """
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in before.split(",") if s != "parquet"))
    try:
        scan = spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", before)
    return scan.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("least", F.min), ("greatest", F.max))])
