"""Quantified comparisons (``x op ALL/ANY (set)``) by their exact three-valued truth tables.

Four aggregates of the set decide every case: its rows, its non-null rows, its
least and its greatest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each operator: what the negated comparison is called.
NEGATED = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def compare(x: Column, op: str, y: Column) -> Column:
    return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def all_holds(x: Column, op: str, rows: Column, filled: Column, low: Column, high: Column) -> Column:
    """``x op ALL (set)``: true for no rows; false if some value fails; else null if x or some value is null."""
    if op in (">", ">="):
        fails = ~compare(x, op, high)
    elif op in ("<", "<="):
        fails = ~compare(x, op, low)
    elif op == "=":
        fails = (x != low) | (x != high)
    else:
        raise ValueError("x <> ALL is NOT IN: membership needs the set itself")
    unknown = F.lit(None).cast("boolean")
    return F.when(rows == 0, True).when(x.isNull(), unknown).when(F.coalesce(fails, F.lit(False)), False).when(filled < rows, unknown).otherwise(True)


def any_holds(x: Column, op: str, rows: Column, filled: Column, low: Column, high: Column) -> Column:
    """``x op ANY (set)`` is the negation of ``x negated-op ALL (set)``."""
    if op == "=":
        raise ValueError("x = ANY is IN: membership needs the set itself")
    return ~all_holds(x, NEGATED[op], rows, filled, low, high)


def quantified(df: DataFrame, x: str, op: str, quantifier: str, values: DataFrame, value: str, on: list[str] | None = None, into: str = "holds") -> DataFrame:
    """``df`` with the boolean column ``into``: ``x op quantifier (value of the rows of values that agree on the columns ``on``)``.

    Without ``on`` the set is one row of aggregates. Otherwise it is aggregated
    by those columns and joined; keys without rows have the empty set.
    """
    on = on or []
    decide = all_holds if quantifier.upper() == "ALL" else any_holds
    names = {"_n": F.count(F.lit(1)), "_nn": F.count(value), "_lo": F.min(value), "_hi": F.max(value)}
    summed = values.groupBy(*on).agg(*[e.alias(n) for n, e in names.items()])
    if (quantifier.upper(), op) in (("ALL", "<>"), ("ANY", "="), ("SOME", "=")):
        members = values.select(*on, F.col(value).alias("_m")).where("_m IS NOT NULL").distinct().withColumn("_in", F.lit(True))
        summed = values.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.count(value).alias("_nn"))
        joined = df.join(summed, on, "left") if on else df.crossJoin(summed)
        joined = joined.join(members.withColumnRenamed("_m", x), [*on, x], "left")
        n, nn = F.coalesce("_n", F.lit(0)), F.coalesce("_nn", F.lit(0))
        unknown = F.lit(None).cast("boolean")
        within = F.when(n == 0, False).when(F.col(x).isNull(), unknown).when(F.col("_in"), True).when(nn < n, unknown).otherwise(False)
        holds = within if op == "=" else ~within
        return joined.withColumn(into, holds).select(*df.columns, into)
    joined = df.join(summed, on, "left") if on else df.crossJoin(summed)
    holds = decide(F.col(x), op, F.coalesce("_n", F.lit(0)), F.coalesce("_nn", F.lit(0)), F.col("_lo"), F.col("_hi"))
    return joined.withColumn(into, holds).select(*df.columns, into)


def quantified_sql(x: str, op: str, quantifier: str, subquery: str, filters: bool = True) -> str:
    """The comparison as SQL text; a correlated subquery stays correlated, for the planner to turn into a join.

    filters: the value only decides whether a row stays. Membership is then IN,
    which becomes a semi or anti join; as a column IN would give false for null.
    """
    op = {"!=": "<>", "==": "="}.get(op, op)
    every = quantifier.upper() == "ALL"
    one = lambda e: f"(SELECT {e} FROM ({subquery}) AS _q(_c))"
    if (every, op) in ((True, "<>"), (False, "=")):
        if filters:
            return f"({x} {'NOT ' * every}IN ({subquery}))"
        among = one("_c").removesuffix(")") + " WHERE _c IS NOT NULL)"
        held = f"CASE WHEN {one('count(*)')} = 0 THEN FALSE WHEN {x} IS NULL THEN CAST(NULL AS BOOLEAN) WHEN {x} IN {among} THEN TRUE WHEN {one('count(*) - count(_c)')} > 0 THEN CAST(NULL AS BOOLEAN) ELSE FALSE END"
        return f"(NOT ({held}))" if every else f"({held})"
    asked = op if every else NEGATED[op]
    low, high = one("min(_c)"), one("max(_c)")
    fails = {">": f"{x} <= {high}", ">=": f"{x} < {high}", "<": f"{x} >= {low}", "<=": f"{x} > {low}", "=": f"({x} <> {low} OR {x} <> {high})"}[asked]
    held = f"CASE WHEN {one('count(*)')} = 0 THEN TRUE WHEN {x} IS NULL THEN CAST(NULL AS BOOLEAN) WHEN {fails} THEN FALSE WHEN {one('count(*) - count(_c)')} > 0 THEN CAST(NULL AS BOOLEAN) ELSE TRUE END"
    return f"({held})" if every else f"(NOT ({held}))"
