"""Stored routines: SQL functions, scripts with control flow, prepared queries and SELECT INTO."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.sql_compat import TOKEN, translate
from quern.types import spark_type


def create_function(spark: SparkSession, name: str, parameters: str, returns: str, expression: str) -> None:
    """An SQL function that the planner inlines; ``parameters`` may have defaults."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {translate(expression)}")


def create_external(spark: SparkSession, name: str, returns: str, where: str) -> None:
    """An SQL function of a Python one, ``function@module``, that maps pandas series to a series; it sees whole Arrow batches."""
    function, module = where.split("@")
    spark.udf.register(name, F.pandas_udf(getattr(importlib.import_module(module), function), returnType=spark_type(returns)))


def script(spark: SparkSession, body: str) -> DataFrame:
    """BEGIN ... END with variables, IF, WHILE, REPEAT, LOOP, FOR, handlers and SIGNAL; the last query is the result."""
    found = [m for m in TOKEN.finditer(body) if m.lastgroup != "space"]
    out, at = "", 0
    for k, m in enumerate(found):
        if m[0].upper() == "SIGNAL" and k + 1 < len(found):
            last = found[k + 2] if found[k + 1][0].upper() == "SQLSTATE" else found[k + 1]
            # A condition that cannot be decided is the statement that fails.
            out += body[at : m.start()] + f"IF CAST(raise_error('{last[0].strip(chr(39))}') AS BOOLEAN) THEN SELECT 1; END IF"
            at = last.end()
    return spark.sql(out + body[at:])


def prepare(spark: SparkSession, query: str):
    """A query with ``?`` or ``:name`` markers that may be run with other values each time."""
    text = translate(query)
    return lambda *values, **named: spark.sql(text, args=list(values) if values else named)


def select_into(spark: SparkSession, query: str, args=None) -> tuple:
    """The values of the only row of a query; none and several are errors."""
    rows = spark.sql(translate(query), args=args).limit(2).collect()
    if len(rows) != 1:
        raise LookupError("no row" if not rows else "more than one row")
    return tuple(rows[0])


def checked(spark: SparkSession, query: str) -> str:
    """The schema of a query, which is analysed and not run."""
    return spark.sql(translate(query)).schema.simpleString()
