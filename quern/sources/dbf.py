"""dBase tables as a Spark data source (``dbf``): fixed records, so that files split into ranges of rows.

Read through ``spark.read.format("dbf").load(path)`` after ``register(spark)``;
memo fields of a file beside it (``.dbt`` or ``.fpt``) are read as text. One file at a path
that Python can open; writes are of one partition by ``write``.
"""

from __future__ import annotations

import datetime
import os
import struct
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD, FIELD, RECORDS = 32, 32, 50_000


def layout(path: str):
    """Rows, header length, record length and (name, kind, width, decimals) of each field."""
    with open(path, "rb") as f:
        head = f.read(HEAD)
        rows, start, width = struct.unpack_from("<IHH", head, 4)
        fields = []
        while (raw := f.read(FIELD)) and raw[0] != 0x0D and len(raw) == FIELD:
            fields.append((raw[:11].split(b"\0")[0].decode("ascii"), chr(raw[11]), raw[16], raw[17]))
    return rows, start, width, fields


def field_type(kind: str, width: int, decimals: int) -> T.DataType:
    if kind == "N":
        return T.DecimalType(max(width, decimals + 1), decimals) if decimals else T.LongType()
    return {"F": T.DoubleType(), "L": T.BooleanType(), "D": T.DateType()}.get(kind, T.StringType())


def value(raw: bytes, kind: str, decimals: int, encoding: str, memo):
    if kind == "M" and len(raw) == 4:  # the newer form: a number of four bytes
        return memo(int.from_bytes(raw, "little"))
    text = raw.decode(encoding, "replace").rstrip(" \0")
    try:
        if kind == "N":
            return (Decimal(text.strip()) if decimals else int(text)) if text.strip() else None
        if kind == "F":
            return float(text) if text.strip() else None
        if kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        if kind == "D":
            return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8])) if text.strip() else None
        if kind == "M":
            return memo(int(text)) if text.strip() else None
    except (ValueError, ArithmeticError):
        return None
    return text or None


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class DbfReader(DataSourceReader):
    def __init__(self, path: str, encoding: str):
        self.path, self.encoding = path, encoding

    def partitions(self):
        rows = layout(self.path)[0]
        return [Range(i, min(i + RECORDS, rows)) for i in range(0, rows, RECORDS)] or [Range(0, 0)]

    def read(self, partition):
        _, start, width, fields = layout(self.path)
        first, last = partition.value
        base = os.path.splitext(self.path)[0]
        memo_path = next((base + e for e in (".dbt", ".DBT", ".fpt", ".FPT") if os.path.exists(base + e)), None)

        def memo(block: int):
            if not memo_path or not block:
                return None
            with open(memo_path, "rb") as m:
                if memo_path.lower().endswith(".fpt"):  # blocks of a size of the file's own; kind and length, then the value
                    (size,) = struct.unpack_from(">H", m.read(8), 6)
                    m.seek(block * (size or 1))
                    _, length = struct.unpack(">II", m.read(8))
                    return m.read(length).decode(self.encoding, "replace")
                m.seek(block * 512)
                out = b""
                while b"\x1a" not in out and (more := m.read(512)):
                    out += more
            return out.split(b"\x1a")[0].decode(self.encoding, "replace")

        with open(self.path, "rb") as f:
            f.seek(start + first * width)
            for _ in range(first, last):
                record = f.read(width)
                if len(record) < width or record[:1] == b"*":  # deleted
                    continue
                at, row = 1, []
                for _, kind, size, decimals in fields:
                    row.append(value(record[at : at + size], kind, decimals, self.encoding, memo))
                    at += size
                yield tuple(row)


class DbfSource(DataSource):
    @classmethod
    def name(cls):
        return "dbf"

    def schema(self):
        return T.StructType([T.StructField(n, field_type(k, w, d)) for n, k, w, d in layout(self.options["path"])[3]])

    def reader(self, schema):
        return DbfReader(self.options["path"], self.options.get("encoding", "cp852"))


def register(spark: SparkSession) -> None:
    from pyspark import cloudpickle

    import quern.sources.dbf as own

    cloudpickle.register_pickle_by_value(own)
    spark.dataSource.register(DbfSource)


def write(df: DataFrame, path: str, widths: dict[str, int] | None = None, encoding: str = "cp852") -> None:
    """One dBase file from the driver, row by row through an iterator: for exports of a size that one file is meant for."""
    widths = widths or {}
    fields = []
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, T.BooleanType):
            fields.append((f.name, "L", 1, 0))
        elif isinstance(t, T.DateType):
            fields.append((f.name, "D", 8, 0))
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            fields.append((f.name, "N", widths.get(f.name, 19), 0))
        elif isinstance(t, T.DecimalType):
            fields.append((f.name, "N", widths.get(f.name, t.precision + 2), t.scale))
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            fields.append((f.name, "F", widths.get(f.name, 20), 6))
        else:
            fields.append((f.name, "C", widths.get(f.name, 254), 0))
    width, n = 1 + sum(f[2] for f in fields), 0
    with open(path, "wb") as out:
        out.write(bytes(HEAD))
        for name, kind, size, decimals in fields:
            out.write(name[:10].encode("ascii").ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([size, decimals]) + bytes(14))
        out.write(b"\r")
        for row in df.toLocalIterator(prefetchPartitions=True):
            cells = []
            for (_, kind, size, decimals), v in zip(fields, row, strict=True):
                if v is None:
                    text = ""
                elif kind == "L":
                    text = "T" if v else "F"
                elif kind == "D":
                    text = v.strftime("%Y%m%d")
                elif kind in "NF":
                    text = (f"{v:.{decimals}f}" if decimals else str(v)).rjust(size)
                else:
                    text = str(v)
                cells.append(text.encode(encoding, "replace")[:size].ljust(size))
            out.write(b" " + b"".join(cells))
            n += 1
        out.write(b"\x1a")
        today = datetime.date.today()
        out.seek(0)
        out.write(struct.pack("<BBBBIHH", 3, today.year - 1900, today.month, today.day, n, HEAD + FIELD * len(fields) + 1, width))
