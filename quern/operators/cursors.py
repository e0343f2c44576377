"""Operations that a client runs on an open query: restriction, aggregates, look-ups, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def restrict(df: DataFrame, condition: str | None = None, order: str | None = None) -> DataFrame:
    out = df.where(condition) if condition else df
    return out.orderBy(*[F.expr(c.strip().rsplit(" ", 1)[0]).desc() if c.strip().lower().endswith(" desc") else F.expr(c.strip().removesuffix(" ASC").removesuffix(" asc")) for c in order.split(",")]) if order else out


def aggregate(df: DataFrame, function: str, column: str | None = None, legacy: bool = False) -> DataFrame:
    """One row, ``value``. legacy: an integer average is truncated, as sums divided by counts."""
    if column is None:
        return df.agg(F.count(F.lit(1)).alias("value"))
    if legacy and function.upper() == "AVG" and df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long"):
        return df.agg(F.expr(f"sum(`{column}`) div count(`{column}`)").alias("value"))
    return df.agg(AGGREGATES[function.upper()](column).alias("value"))


def look_up(df: DataFrame, column: str, value) -> DataFrame:
    """A row with this value, at most one."""
    return df.where(F.col(column) == F.lit(value)).limit(1)


def closest(df: DataFrame, key: str, value) -> DataFrame:
    """The row of the least key that is not below ``value``: a top-1, not a sort."""
    return df.where(F.col(key) >= F.lit(value)).orderBy(key).limit(1)


def find_text(column: Column, wanted: str, start: int = 1, ignore_case: bool = False) -> Column:
    """1-based position from ``start`` on, 0 if none."""
    return F.locate(wanted.lower(), F.lower(column), start) if ignore_case else F.locate(wanted, column, start)


def fetch(df: DataFrame, order: list[str], position: int) -> DataFrame:
    """FETCH ABSOLUTE: the row at a 1-based position; negative ones count from the end."""
    if position < 0:
        return df.orderBy(*[F.desc(c) for c in order]).offset(-position - 1).limit(1)
    return df.orderBy(*order).offset(position - 1).limit(1)


def single_value(spark: SparkSession, query: str, args=None):
    """The value of a query of one row and one column; an error otherwise."""
    rows = spark.sql(query, args=args).limit(2).collect()
    if len(rows) != 1 or len(rows[0]) != 1:
        raise ValueError("the query must give exactly one row of one column")
    return rows[0][0]


def rows_between(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    return df.orderBy(*order).offset(first - 1).limit(last - first + 1)


def without_repeats(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stable order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
