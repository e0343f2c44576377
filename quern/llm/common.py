"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import uuid
import weakref
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a text under every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def shipped(name: str) -> None:
    """Pickle the functions of the module ``name`` by value: executors then need no copy of the repository."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


shipped(__name__)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a local session gets one of its own; on a cluster, where
    executors don't see each other's disks, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths of the tables that ``materialize`` has written and ``release`` has not deleted.
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: Tables written inside each open ``scope``, the innermost last.
_scopes: list[list[DataFrame]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The folder goes with ``release``, at the end of the ``scope`` it was written
    in, or when the session ends. The planner knows the size of what it reads,
    so that small results are broadcast and large ones are not.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = located(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more; others are left alone."""
    for table in tables:
        if path := _paths.pop(table, None):
            where, files = located(table.sparkSession, path)
            files.delete(where, True)


@contextmanager
def scope():
    """Tables written inside are deleted at the end, but for those handed to the function this gives.

    What is lazy and reads the others must be written before.
    """
    own: list[DataFrame] = []
    _scopes.append(own)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    kept: list[DataFrame] = []
    try:
        yield keep
    finally:
        _scopes.pop()
        release(*[t for t in own if not any(t is k for k in kept)])
        if _scopes:
            _scopes[-1].extend(kept)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once; an expression named twice may be computed twice."""
    return F.transform(F.array(value), use)[0]


def longs(values: list[int]) -> Column:
    """A literal array, parsed once by constant folding (a call for each element would be slow)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(T.ArrayType(T.LongType())) if values else F.array().cast(T.ArrayType(T.LongType()))


def chance(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def bucket_of(key: Column, splitters: list[int]) -> Column:
    """How many of the ascending ``splitters`` lie below ``key``, by binary search inside one expression.

    The splitters travel as one literal array, padded to a power of two.
    """
    depth = max(1, (len(splitters)).bit_length())
    padded = splitters + [2**63 - 1] * ((1 << depth) - 1 - len(splitters))
    steps = F.array(*[F.lit(1 << k) for k in range(depth - 1, -1, -1)])
    table = longs(padded)
    return F.aggregate(steps, F.lit(0), lambda at, half: F.when(F.element_at(table, at + half) < key, at + half).otherwise(at))


def extend(df: DataFrame, text: str, new: dict[str, T.DataType], worker, *args) -> DataFrame:
    """``df`` with new columns that Python computes from the column ``text``, Arrow batch by batch.

    worker(*args) runs once in each task and gives a function from a list of
    texts (null: empty) to one Arrow array for each new column. Columns of
    ``df`` with the new names are replaced. Batches are cut small, so that a
    task holds few texts at a time.
    """
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in new} or c == text]
    passed = [c for c in kept if c.lower() not in {n.lower() for n in new}]
    schema = T.StructType([df.schema[c] for c in passed] + [T.StructField(n, t) for n, t in new.items()])
    names = [*passed, *new]

    def run(batches):
        compute = worker(*args)
        for batch in batches:
            for small in pieces(batch):
                values = [x or "" for x in small.column(small.schema.get_field_index(text)).to_pylist()]
                gc.disable()  # the workers make many small lists and no cycles
                try:
                    made = compute(values)
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays([small.column(small.schema.get_field_index(c)) for c in passed] + made, names=names)

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def pieces(batch, rows: int = 512, size: int = 8 << 20):
    """Slices of an Arrow batch of at most ``rows`` rows and about ``size`` bytes."""
    step = max(1, min(rows, int(rows * size / max(batch.nbytes * rows / max(batch.num_rows, 1), 1))))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)
