"""Inserts, updates, deletes and upserts as new DataFrames, with checks of constraints.

File tables are not changed in place: ``replace_table`` writes the new rows
beside the table and swaps directories, so that a source may be its own target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import written


def insert(table: DataFrame, rows: DataFrame, columns: list[str] | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """``table`` with ``rows``, whose columns fill ``columns`` by position; others get their default or null."""
    columns = columns or table.columns[: len(rows.columns)]
    if len(columns) != len(rows.columns):
        raise ValueError("as many columns as values are needed")
    named = rows.toDF(*columns)
    defaults = defaults or {}
    full = [(F.col(c) if c in columns else defaults.get(c, F.lit(None))).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    return table.union(named.select(*full))


def update(table: DataFrame, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Rows for which ``where`` is true get new values, all computed from the old row."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return table.select(*[F.when(hit, values[c].cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows for which ``where`` is true go; those for which it is null stay."""
    return table.where(~F.coalesce(where, F.lit(False))) if where is not None else table.limit(0)


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``table`` replaced by those of equal key, and the others of ``rows`` added."""
    kept = table.join(rows.select(*key).distinct(), key, "left_anti")
    return kept.select(*table.columns).unionByName(rows.select(*table.columns))


def unique_violations(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number; keys with a null part never clash."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    return table.where(whole).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_violations(table: DataFrame, check: Column) -> DataFrame:
    """Rows for which a check is false; null passes."""
    return table.where(~F.coalesce(check, F.lit(True)))


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``child`` without the parent they refer to; a null part refers to none."""
    keys = parent.select(*[F.col(k).alias(f"_{k}") for k in key])
    condition, whole = F.lit(True), F.lit(True)
    for c, k in zip(columns, key, strict=True):
        condition, whole = condition & (F.col(c) == F.col(f"_{k}")), whole & F.col(c).isNotNull()
    return child.where(whole).join(keys, condition, "left_anti")


def cascade_delete(parent: DataFrame, key: str, where: Column, child: DataFrame, column: str, action: str = "CASCADE", default: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Parent and child after deleting parents: children go, or their reference becomes null or the default; NO ACTION leaves them to ``orphans``."""
    gone = parent.where(F.coalesce(where, F.lit(False))).select(F.col(key).alias("_gone")).distinct()
    left = delete(parent, where)
    if action == "CASCADE":
        return left, child.join(gone, F.col(column) == F.col("_gone"), "left_anti")
    if action == "NO ACTION":
        return left, child
    value = F.lit(None) if action == "SET NULL" else default
    marked = child.join(gone, F.col(column) == F.col("_gone"), "left")
    return left, marked.withColumn(column, F.when(F.col("_gone").isNotNull(), value).otherwise(F.col(column)).cast(child.schema[column].dataType)).drop("_gone")


def cascade_update(parent: DataFrame, key: str, value: Column, where: Column, child: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Parent and child after a change of parent keys that children follow."""
    changed = parent.where(F.coalesce(where, F.lit(False))).select(F.col(key).alias("_old"), value.cast(parent.schema[key].dataType).alias("_new"))
    moved = child.join(changed, F.col(column) == F.col("_old"), "left").withColumn(column, F.when(F.col("_old").isNotNull(), F.col("_new")).otherwise(F.col(column))).drop("_old", "_new")
    return update(parent, {key: value}, where), moved


def sequence(df: DataFrame, order: list[str], start: int = 1, step: int = 1, into: str = "value", minimum: int | None = None, maximum: int | None = None, cycle: bool = False) -> DataFrame:
    """Consecutive sequence values in a stable order, numbered range by range: no task holds all rows.

    Rows of equal ``order`` follow by their other columns. Beyond ``maximum``
    (``minimum`` for negative steps) values go on from the other bound if
    ``cycle``; otherwise the sequence is exhausted, which is an error.
    """
    by = order + [f.name for f in df.schema.fields if f.name not in order and f.dataType.typeName() not in ("map", "variant")]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = written(ranged)  # ranges are sampled: both uses need the same ones
    held = {r[0]: r[1] for r in ranged.groupBy("_part").count().collect()}  # one row a partition
    before, at = {}, 0
    for p in sorted(held):
        before[p], at = at, at + held[p]
    offsets = F.create_map(*[F.lit(x) for p in before for x in (p, before[p])]) if before else F.create_map(F.lit(0), F.lit(0))
    number = F.try_element_at(offsets, F.col("_part")) + F.col("_at")
    value = F.lit(start) + number * step
    last, first = (maximum, minimum) if step > 0 else (minimum, maximum)
    if last is not None:
        once = (last - start) // step + 1  # values until the bound
        again = F.raise_error(F.lit("the sequence is exhausted"))
        if cycle:
            first = (1 if step > 0 else -1) if first is None else first
            again = F.lit(first) + (number - once) % ((last - first) // step + 1) * step
        value = F.when(number < once, value).otherwise(again)
    return ranged.withColumn(into, value.cast("long")).drop("_part", "_at")


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as the Parquet table at ``path``, which ``df`` may read: new files first, then the swap."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, old = f"{path}.new", f"{path}.old"
    fs.delete(where(new), True)
    df.write.parquet(new)
    fs.delete(where(old), True)
    if fs.exists(where(path)):
        fs.rename(where(path), where(old))
    fs.rename(where(new), where(path))
    fs.delete(where(old), True)
