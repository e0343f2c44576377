"""Import and export: delimited, fixed-width, Parquet, XML and JDBC, with the dialect's formats."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import conversions
from quern.types import spark_type

#: Names of encodings in the dialect, and Java's.
ENCODINGS = {"CP1250": "windows-1250", "CP1252": "windows-1252", "ISO646": "US-ASCII", "8859-1": "ISO-8859-1", "8859-2": "ISO-8859-2", "IBM852": "IBM852", "UTF8": "UTF-8", "UCS2": "UTF-16LE", "UCS4": "UTF-32LE"}

#: What a reader takes for null inside: no character, so that no text is equal to it, and an empty text in quotes is none.
NOTHING = "\ufdd0"


@dataclass(frozen=True)
class Format:
    separator: str = ","
    quote: str = '"'
    header: bool = True
    skip_lines: int = 0
    decimal: str = "."
    date: str = "DD.MM.CCYY"
    timestamp: str = "DD.MM.CCYY hh:mm:ss"
    true: str = "TRUE"
    false: str = "FALSE"
    encoding: str = "UTF8"
    line_breaks: bool = False  # quoted values may hold line breaks: a file is then read by one task


def code_page(form: Format) -> str | None:
    """The characters that stand for the 256 bytes of a one-byte encoding that extends ASCII (U+FFFD: for none); else nothing.

    Such files go through Spark as ISO-8859-1, a character for each byte, whatever
    encodings the session's settings admit.
    """
    try:
        page = bytes(range(256)).decode(ENCODINGS.get(form.encoding, form.encoding), "replace")
    except LookupError:
        return None
    return page if len(page) == 256 and page[:128] == bytes(range(128)).decode() and page[128:].strip("\ufffd") else None


def spark_encoding(form: Format) -> str:
    return "ISO-8859-1" if code_page(form) else ENCODINGS.get(form.encoding, form.encoding)


def as_bytes(column: Column, form: Format) -> Column:
    """Text with each character as the one of ISO-8859-1 that has its byte; one that the encoding lacks is an error."""
    if not (page := code_page(form)):
        return column
    coded = {c: chr(b) for b, c in enumerate(page) if b > 127 and c != "\ufffd"}
    lacks = F.concat(F.lit(f"{form.encoding} has no code for a character of: "), column)
    known = F.translate(column, "".join(coded), "".join(coded.values()))
    return F.when(column.rlike(f"[^\\x00-\\x7f{''.join(map(escaped, coded))}]"), F.raise_error(lacks)).otherwise(known)


def from_bytes(column: Column, form: Format) -> Column:
    """Text that was read as ISO-8859-1, in its characters."""
    if not (page := code_page(form)):
        return column
    return F.translate(column, "".join(map(chr, range(128, 256))), page[128:])


def byte_form(text: str, form: Format) -> str:
    """The same as ``as_bytes`` for a separator or name."""
    return text.encode(ENCODINGS.get(form.encoding, form.encoding)).decode("latin-1") if code_page(form) else text


def escaped(c: str) -> str:
    return f"\\x{{{ord(c):x}}}"


def csv_options(form: Format) -> dict[str, str]:
    return {"sep": byte_form(form.separator, form), "quote": byte_form(form.quote, form), "escape": byte_form(form.quote, form), "encoding": spark_encoding(form)}


def parsed(column: Column, kind: str, form: Format) -> Column:
    """Text as a typed value; what doesn't parse is null."""
    kind = spark_type(kind).simpleString() if kind.upper() == kind else kind
    if kind == "string":
        return column
    column = F.nullif(column, F.lit(""))
    if kind == "boolean":
        return conversions.str2bool(column, form.true, form.false)
    if kind == "date":
        return conversions.str2date(column, form.date)
    if kind.startswith("timestamp"):
        return conversions.str2timestamp(column, form.timestamp)
    if kind == "double" or kind == "float" or kind.startswith("decimal"):
        return F.replace(F.trim(column), F.lit(form.decimal), F.lit(".")).try_cast(kind)
    return F.trim(column).try_cast(kind)


def printed(column: Column, kind: T.DataType, form: Format) -> Column:
    if isinstance(kind, T.BooleanType):
        return conversions.bool2str(column, form.true, form.false)
    if isinstance(kind, T.DateType):
        return F.date_format(column, conversions.spark_format(form.date))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, conversions.spark_format(form.timestamp))
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.replace(column.cast("string"), F.lit("."), F.lit(form.decimal))
    return column.cast("string")


def lines(spark: SparkSession, path: str, form: Format, skip: int = 0) -> DataFrame:
    """value: the lines of the files at ``path``, without the first ``skip`` of each.

    Lines are told by their place: those of the split that starts a file are in
    order, and where that split's lines begin is one row for each file.
    """
    text = spark.read.option("encoding", spark_encoding(form)).text(path)
    if code_page(form):  # this reader takes the bytes as they are
        text = text.withColumn("value", from_bytes(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), form))
    if not skip:
        return text
    placed = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    heads = placed.where("at = 0").groupBy("file").agg(F.min("id").alias("first"))
    return placed.join(heads, "file", "left").where(~((F.col("at") == 0) & (F.col("id") - F.col("first") < skip))).select("value")


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], form: Format = Format()) -> DataFrame:
    """Delimited text with the columns ``columns`` (name: type), in the file's order; a quoted empty text is no null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    if form.skip_lines:
        body = lines(spark, path, form, form.skip_lines + form.header)
        fields = F.from_csv("value", F.lit(schema), {"sep": form.separator, "quote": form.quote, "escape": form.quote, "nullValue": NOTHING})
        raw = body.select(fields.alias("r")).select("r.*")
    else:
        raw = spark.read.schema(schema).options(**csv_options(form), mode="PERMISSIVE", nullValue=NOTHING, header=form.header, multiLine=form.line_breaks).csv(path)
        raw = raw.select(*[from_bytes(F.col(f"`{c}`"), form).alias(c) for c in columns])
    return raw.select(*[parsed(F.col(f"`{c}`"), k, form).alias(c) for c, k in columns.items()])


def write_csv(df: DataFrame, path: str, form: Format = Format(), mode: str = "errorifexists") -> None:
    """Null is written as nothing, an empty text as two quotes; blanks around a text stay."""
    out = df.select(*[as_bytes(printed(F.col(f"`{f.name}`"), f.dataType, form), form).alias(byte_form(f.name, form)) for f in df.schema.fields])
    out.write.mode(mode).options(**csv_options(form), header=form.header, emptyValue=2 * byte_form(form.quote, form), ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_fixed(spark: SparkSession, path: str, columns: Iterable[tuple[str, int, str]], form: Format = Format(header=False)) -> DataFrame:
    """Fixed-width text: (name, width, type) in order; values lose the blanks on their right."""
    rows, at, out = lines(spark, path, form), 1, []
    for name, width, kind in columns:
        out.append(parsed(F.nullif(F.rtrim(F.substring("value", at, width)), F.lit("")), kind, form).alias(name))
        at += width
    return rows.select(*out)


def write_fixed(df: DataFrame, path: str, widths: list[int], form: Format = Format(header=False), mode: str = "errorifexists") -> None:
    cells = [F.rpad(F.coalesce(printed(F.col(f"`{f.name}`"), f.dataType, form), F.lit("")), w, " ") for f, w in zip(df.schema.fields, widths, strict=True)]
    value = F.concat(*cells)
    if code_page(form):  # this writer puts bytes as they are
        value = F.encode(as_bytes(value, form), "ISO-8859-1").cast("string")
    df.select(value.alias("value")).write.mode(mode).option("encoding", spark_encoding(form)).text(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def write_xml(df: DataFrame, path: str, row_tag: str = "row", root_tag: str = "rows", mode: str = "errorifexists") -> None:
    df.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).mode(mode).save(path)


def read_jdbc(spark: SparkSession, url: str, source: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A table, view or parenthesised query; with a numeric ``column`` and its bounds read in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", source).options(**options)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def transport(source: DataFrame, where: str | None, mapping: dict[str, tuple[str, str]], form: Format = Format()) -> DataFrame:
    """Rows of ``source`` that meet ``where``, as target columns: name -> (source expression, type)."""
    rows = source.where(where) if where else source
    out = []
    for name, (expression, kind) in mapping.items():
        value = F.expr(expression)
        is_text = isinstance(rows.select(value.alias("v")).schema["v"].dataType, T.StringType)
        out.append((parsed(value, kind, form) if is_text else value.try_cast(spark_type(kind))).alias(name))
    return rows.select(*out)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """External large objects: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(path)
