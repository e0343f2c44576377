"""SQL type spellings of the dialect, and Spark's types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings without parameters.
PLAIN = {
    "BOOLEAN": T.BooleanType(), "BIT": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(),
    "REAL": T.DoubleType(), "FLOAT": T.DoubleType(), "DOUBLE PRECISION": T.DoubleType(), "MONEY": T.DecimalType(15, 2), "CHAR": T.StringType(), "DATE": T.DateType(), "TIME": T.IntegerType(),
    "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP WITH TIME ZONE": T.TimestampType(), "TIME WITH TIME ZONE": T.IntegerType(),
    "CLOB": T.StringType(), "NCLOB": T.StringType(), "LONG VARCHAR": T.StringType(), "CHAR LARGE OBJECT": T.StringType(), "BLOB": T.BinaryType(), "VARBINARY": T.BinaryType(), "LONG VARBINARY": T.BinaryType(),
    "EXTCLOB": T.StringType(), "EXTNCLOB": T.StringType(), "EXTBLOB": T.BinaryType(), "HANDLE": T.LongType(),
}
COLLATIONS = {"IGNORE_CASE": "UTF8_LCASE", "CSISTRING": "cs_CI", "CZECH": "cs"}


def spark_type(spelling: str, domains: dict[str, str] | None = None) -> T.DataType:
    """The type of a spelling; ``domains`` are looked up by name. Exact numbers have 18 digits at most."""
    text = re.sub(r"\s+", " ", spelling.strip()).upper()
    if domains and text in {d.upper() for d in domains}:
        return spark_type(next(v for k, v in domains.items() if k.upper() == text), domains)
    if text in PLAIN:
        return PLAIN[text]
    if m := re.fullmatch(r"(N?CHAR|VARCHAR|CHARACTER|CHARACTER VARYING|CHAR VARYING) ?\((\d+)\)( COLLATE (\w+)| IGNORE_CASE)?", text):
        collation = m[4] or ("IGNORE_CASE" if m[3] else None)
        return T.StringType(COLLATIONS.get(collation, collation)) if collation else T.StringType()
    if m := re.fullmatch(r"(BINARY|VARBINARY) ?\((\d+)\)", text):
        return T.BinaryType()
    if m := re.fullmatch(r"(NUMERIC|DECIMAL|DEC)( ?\((\d+)(?: ?, ?(\d+))?\))?", text):
        return T.DecimalType(min(int(m[3] or 10), 18), int(m[4] or 0))
    if re.fullmatch(r"(BI)?POINTER? ?\[.*\]|BIPTR ?\[.*\]", text):
        return T.LongType()
    raise ValueError(f"no such type: {spelling}")


def stored(column: Column, spelling: str) -> Column:
    """A value as a column of this type holds it: strings cut to their length, timestamps to seconds, overflow and bad text null."""
    kind = spark_type(spelling)
    if m := re.search(r"CHAR\w* ?\((\d+)\)", spelling.upper()):
        return F.left(column.cast("string"), F.lit(int(m[1])))
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.date_trunc("second", column.try_cast(kind)).cast(kind)
    return column.try_cast(kind)
