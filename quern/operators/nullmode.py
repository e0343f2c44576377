"""Comparisons in the legacy null mode, where null equals null and sorts below every value; and empty strings as nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def less(a: Column, b: Column) -> Column:
    return F.coalesce(a < b, a.isNull() & b.isNotNull())


def compare(a: Column, op: str, b: Column) -> Column:
    """Two-valued: never null."""
    return {"=": equal(a, b), "<>": ~equal(a, b), "<": less(a, b), ">": less(b, a), "<=": ~less(b, a), ">=": ~less(a, b)}[op]


def join_equal(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the planner still hashes it."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return left.join(right, condition, how)


def empty_as_null(df: DataFrame) -> DataFrame:
    """Empty strings and all-zero binaries become nulls."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            out[f.name] = F.nullif(F.col(f.name), F.lit(""))
        elif isinstance(f.dataType, T.BinaryType):
            out[f.name] = F.when(F.length(F.replace(F.hex(f.name), F.lit("0"), F.lit(""))) > 0, F.col(f.name))
    return df.withColumns(out) if out else df
