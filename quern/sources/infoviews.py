"""Catalog views as DataFrames: columns, tables, row counts, constraints, types; tables and their definitions as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Type names of the dialect, their numeric codes as ODBC has them, and Spark's type.
TYPES = (("BOOLEAN", -7, "boolean"), ("TINYINT", -6, "tinyint"), ("SMALLINT", 5, "smallint"), ("INTEGER", 4, "int"), ("BIGINT", -5, "bigint"), ("DECIMAL", 3, "decimal(18,2)"), ("DOUBLE PRECISION", 8, "double"),
         ("CHAR", 1, "string"), ("VARCHAR", 12, "string"), ("BINARY", -2, "binary"), ("DATE", 91, "date"), ("TIME", 92, "int"), ("TIMESTAMP", 93, "timestamp_ntz"), ("CLOB", -1, "string"), ("BLOB", -4, "binary"))


def table_columns(spark: SparkSession) -> DataFrame:
    """table_name, column_name, ordinal, type_name, nullable of every table and view of the session."""
    rows = [(t.name, f.name, k, f.dataType.simpleString(), f.nullable) for t in spark.catalog.listTables() for k, f in enumerate(spark.table(t.name).schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, type_name string, nullable boolean")


def tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name, "VIEW" if t.isTemporary else "TABLE") for t in spark.catalog.listTables()], "table_name string, kind string")


def table_space(spark: SparkSession, names: list[str]) -> DataFrame:
    """table_name, n_rows; counts of Parquet tables come from footers."""
    out = None
    for name in names:
        one = spark.table(name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def constraints(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """table_name, kind, text of the keys, checks and indexes that tables were created with, or of one kind of them."""
    rows = []
    for t in spark.catalog.listTables():
        if not t.isTemporary:
            kept = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES `{t.name}`").collect()}.get("quern.constraints", "[]")
            rows += [(t.name, *c) for c in json.loads(kept) if kind in (None, c[0])]
    return spark.createDataFrame(rows, "table_name string, kind string, text string")


def session_info(spark: SparkSession) -> DataFrame:
    """user_name, schema_name, catalog_name of the session."""
    return spark.sql("SELECT current_user() AS user_name, current_schema() AS schema_name, current_catalog() AS catalog_name")


def type_info(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TYPES), "type_name string, data_type int, spark_type string")


def odbc_columns(spark: SparkSession) -> DataFrame:
    """table_name, column_name, data_type (the code of the first of the dialect's types that Spark's type stands for, null where there is none), type_name, ordinal, nullable."""
    first = {}
    for _, code, kind in TYPES:
        first.setdefault(kind, code)
    codes = spark.createDataFrame(list(first.items()), "type_name string, data_type int")
    return table_columns(spark).join(F.broadcast(codes), "type_name", "left").select("table_name", "column_name", "data_type", "type_name", "ordinal", "nullable")


def viewed_columns(spark: SparkSession) -> DataFrame:
    """table_columns of the views alone."""
    return table_columns(spark).join(tables(spark).where("kind = 'VIEW'"), "table_name", "left_semi")


#: Views by name, as they stand in FROM.
VIEWS = {
    "_iv_table_columns": table_columns, "_iv_viewed_table_columns": viewed_columns, "_iv_check_constraints": lambda s: constraints(s, "CHECK"), "_iv_foreign_keys": lambda s: constraints(s, "FOREIGN KEY"),
    "_iv_indicies": lambda s: constraints(s).where("kind IN ('INDEX', 'UNIQUE', 'PRIMARY KEY')"), "_iv_odbc_tables": tables, "_iv_odbc_columns": odbc_columns, "_iv_odbc_types": type_info,
    "_iv_odbc_primary_keys": lambda s: constraints(s, "PRIMARY KEY"), "_iv_odbc_foreign_keys": lambda s: constraints(s, "FOREIGN KEY"),
}


def register(spark: SparkSession) -> None:
    """Temporary views of the catalog as it is now; none of them lists another."""
    for name in VIEWS:
        spark.catalog.dropTempView(name)
    for name, frame in {n: v(spark) for n, v in VIEWS.items()}.items():
        frame.createOrReplaceTempView(name)


def export_schema(spark: SparkSession, path: str, names: list[str] | None = None) -> None:
    """Each table (all that are no views, or ``names``) as a folder of Parquet files below ``path``, with the definitions as JSON beside them."""
    names = names or [r.table_name for r in tables(spark).where("kind = 'TABLE'").collect()]
    kept = {(r.table_name, r.kind, r.text) for r in constraints(spark).collect()}
    rows = [(n, spark.table(n).schema.json(), json.dumps(sorted(c[1:] for c in kept if c[0] == n))) for n in names]
    for n in names:
        spark.table(n).write.parquet(f"{path}/{n}")
    spark.createDataFrame(rows, "name string, schema string, constraints string").coalesce(1).write.json(f"{path}/_definitions.json")


def import_schema(spark: SparkSession, path: str, rename=lambda name: name) -> list[str]:
    """The tables that ``export_schema`` wrote, under the names that ``rename`` gives them."""
    made = []
    for r in spark.read.schema("name string, schema string, constraints string").json(f"{path}/_definitions.json").collect():  # one row a table
        name = rename(r.name)
        spark.read.schema(StructType.fromJson(json.loads(r.schema))).parquet(f"{path}/{r.name}").write.format("parquet").saveAsTable(name)
        text = r.constraints.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE `{name}` SET TBLPROPERTIES ('quern.constraints' = '{text}')")
        made.append(name)
    return made
