"""Numeric functions of the legacy dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sqr(x: Column) -> Column:
    return x * x


def round_(x: Column, kind: str = "int") -> Column:
    """Half away from zero; out of range gives null. kind: int or bigint."""
    return F.round(x).try_cast(kind)


def trunc(x: Column) -> Column:
    """Towards zero; out of range gives null."""
    return (F.signum(x) * F.floor(F.abs(x))).try_cast("int")


def odd(x: Column) -> Column:
    return x.bitwiseAND(F.lit(1)) != 0


def div(a: Column, b: Column) -> Column:
    """Whole quotient of whole numbers, truncated towards zero, exact in all 64 bits."""
    return F.call_function("div", a, b)


def add_money(a: Column, b: Column) -> Column:
    """Amounts add with null as nothing: null only if both are."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def subtract_money(a: Column, b: Column) -> Column:
    return F.when(b.isNull(), a).when(a.isNull(), -b).otherwise(a - b)


def legacy_avg(x: Column) -> Column:
    """Average in the argument's whole-number type."""
    return div(F.sum(x), F.count(x))
