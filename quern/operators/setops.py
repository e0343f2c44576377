"""Set operations by common column names, and the union join."""

from __future__ import annotations

from pyspark.sql import DataFrame


def common_columns(left: DataFrame, right: DataFrame, by: list[str] | None = None) -> list[str]:
    """Columns that both have, in the left one's order; or those listed, which both must have."""
    theirs = {c.lower() for c in right.columns}
    common = [c for c in left.columns if c.lower() in theirs]
    if by:
        missing = [c for c in by if c.lower() not in {x.lower() for x in common}]
        if missing:
            raise ValueError(f"no common columns {missing}")
        common = list(by)
    if not common:
        raise ValueError("the operands have no common column")
    return common


def corresponding(left: DataFrame, right: DataFrame, op: str, all_: bool = False, by: list[str] | None = None) -> DataFrame:
    """``left op [ALL] CORRESPONDING [BY (by)] right`` for UNION, EXCEPT and INTERSECT."""
    names = common_columns(left, right, by)
    a, b = left.select(*names), right.select(*names)
    if op.upper() == "UNION":
        return a.union(b) if all_ else a.union(b).distinct()
    if op.upper() == "EXCEPT":
        return a.exceptAll(b) if all_ else a.subtract(b)
    if op.upper() == "INTERSECT":
        return a.intersectAll(b) if all_ else a.intersect(b)
    raise ValueError(op)


def union_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows with nulls for the right columns, then right rows with nulls for the left ones; nothing is matched."""
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if clash:
        raise ValueError(f"rename {sorted(clash)} first: every column of both sides is kept")
    return left.unionByName(right, allowMissingColumns=True)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two tables of equal columns has, repeats counted; ``side`` says which."""
    from pyspark.sql import functions as F

    other = right.select(*left.columns)
    return left.exceptAll(other).withColumn("side", F.lit("left")).union(other.exceptAll(left).withColumn("side", F.lit("right")))
