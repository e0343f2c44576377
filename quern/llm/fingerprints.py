"""Document fingerprints by winnowing.

Every run of ``GRAM`` bytes of a text is hashed. Of each window of ``WINDOW``
runs in a row the least hash is chosen, the rightmost of equal ones, and kept
with its position. Two texts that share a passage of ``GRAM + WINDOW - 1`` bytes
then share a chosen hash, and its positions say where the passage lies.

A chosen run is one long: the hash's upper 32 bits above the position counted
backwards, so that the least value is the rightmost of the least hashes. Windows
of 2, 4, 8, ... runs are minima of two half as wide, so that a window costs the
logarithm of its width. A text is hashed in slices of ``SLICE`` windows, of which
only the chosen runs stay: a task holds a slice's hashes, never a long text's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bucket_of, fresh, let, longs

GRAM, WINDOW = 16, 32
PLACES = 1 << 31
LEAST = -(2**63)
#: Windows of a slice.
SLICE = 1 << 15
#: Rows and bytes of a range of neighbours that are aimed at, and the most ranges.
RANGE_ROWS, RANGE_BYTES, MOST_RANGES = 256, 1 << 20, 1 << 16


def grams(data: Column, before: Column) -> Column:
    """Hash and position of each run of bytes; a short text is one run. before: bytes that come before ``data``."""
    def of(b: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.octet_length(b) - (GRAM - 1), F.lit(1))),
            lambda i: F.shiftrightunsigned(F.xxhash64(F.substring(b, i, F.lit(GRAM))), 32) * F.lit(PLACES) + (F.lit(PLACES) - before - i))

    return let(data, of)


def window_minima(runs: Column) -> Column:
    """The least of the ``WINDOW`` values from each one on; of those that are left, near the end."""
    def wider(by: int):
        return lambda a: F.zip_with(a, F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0))), lambda x, y: F.least(x, F.coalesce(y, x)))

    by = 1
    while by < WINDOW:
        runs = let(runs, wider(by))
        by *= 2
    return runs


def chosen(data: Column, before: Column, least: Column) -> Column:
    """The different runs that the windows of some bytes choose, by position; at least ``least`` windows are asked, also short ones."""
    def of(runs: Column) -> Column:
        return let(window_minima(runs), lambda m: F.array_distinct(F.slice(m, F.lit(1), F.greatest(F.size(m) - (WINDOW - 1), least))))

    def sliced(d: Column) -> Column:
        part = lambda k: of(grams(F.substring(d, k * SLICE + 1, F.lit(SLICE + GRAM + WINDOW - 2)), before + k * SLICE))
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(d) - (GRAM + WINDOW - 1)) / SLICE).cast("int")), part)))

    # Most texts are one slice, and need no copy of it.
    return let(data, lambda d: F.when(F.octet_length(d) <= SLICE, of(grams(d, before))).otherwise(sliced(d)))


def winnow(text: Column) -> Column:
    """Chosen runs of a text, by position. Null and empty texts have one run, of no bytes."""
    return chosen(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), F.lit(0), F.lit(1))


def position(run: Column) -> Column:
    """Bytes before a chosen run."""
    return F.lit(PLACES - 1) - run.bitwiseAND(F.lit(PLACES - 1))


def hashes(runs: Column) -> Column:
    return F.array_distinct(F.transform(runs, lambda v: F.shiftright(v, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Common part of the different hashes of two fingerprints, 0 to 1."""
    return let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), lambda s: let(
        F.size(F.array_intersect(s["a"], s["b"])), lambda n: n / (F.size(s["a"]) + F.size(s["b"]) - n)))


def written(runs: Column) -> Column:
    """``hash@position`` of the chosen runs, comma-joined."""
    return F.array_join(F.transform(runs, lambda v: F.concat_ws("@", F.lpad(F.lower(F.hex(F.shiftright(v, 31))), 8, "0"), position(v).cast("string"))), ",")


def winnow_replaced(runs: Column, head: Column, tail: Column) -> Column:
    """Chosen runs of ``head || tail``, of which those of a text that starts with ``head`` are known.

    Windows inside ``head`` choose what they chose before: the runs up to the
    last such window's choice. Only windows that reach into ``tail`` are new.
    """
    size = F.octet_length(head)
    new = F.greatest(size - (GRAM + WINDOW - 3), F.lit(1))  # first window that isn't inside head
    data = F.encode(F.concat(head, tail), "UTF-8")

    def old(s: Column) -> Column:
        last = F.array_min(F.filter(s["runs"], lambda v: position(v).between(s["new"] - 2, s["new"] + (WINDOW - 3))))
        return F.when(s["new"] > 1, let(last, lambda m: F.filter(s["runs"], lambda v: position(v) <= position(m)))).otherwise(F.array().cast("array<bigint>"))

    def added(s: Column) -> Column:
        return chosen(F.substring(s["data"], s["new"], F.octet_length(s["data"])), s["new"] - 1, F.when(s["new"] > 1, 0).otherwise(1))

    return let(F.struct(runs.alias("runs"), new.alias("new"), data.alias("data")), lambda s: F.array_distinct(F.concat(old(s), added(s))))


def fingerprinted(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``runs``: array of chosen runs. Equal texts have equal ones; a column of this name is replaced."""
    return documents.drop("runs").withColumn("runs", winnow(F.col(text)))


def with_next(documents: DataFrame, identity: str, carried: list[str], ties: list[str], computed: dict[str, Column] | None = None) -> DataFrame:
    """``documents`` with the columns ``computed`` and ``next``: a struct of the ``carried`` columns of the next row by descending identity.

    The last row's next is the first. Nulls come last; ``ties`` order rows of
    equal identity. Rows are dealt into ranges between quantiles of the
    identity, each of which also holds, as guests, the rows that follow its
    last: so one shuffle serves, and no range depends on another. What is
    ``computed`` is so after the shuffle and never moves. Columns named ``next``
    or like a computed one are replaced; no rows give no rows.
    """
    key = F.coalesce(F.col(identity), F.lit(LEAST))
    size = F.lit(0)
    for c in carried:
        if c in documents.columns:
            size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    n, most, held = documents.agg(F.count(F.lit(1)), F.max(key), F.sum(size.cast("long"))).first()
    ranges = max(1, min(MOST_RANGES, max(n // RANGE_ROWS, (held or 0) // RANGE_BYTES)))
    shares = F.split(F.lit(",".join(repr(i / ranges) for i in range(1, ranges + 1))), ",").cast("array<double>")
    cuts = sorted(set(documents.agg(F.percentile_approx(key, shares, F.lit(20 * ranges))).first()[0] or []))
    own = bucket_of(key, cuts)
    place = lambda b, guest: F.struct(b.cast("int").alias("range"), F.lit(guest).alias("guest"))
    # Ranges are closed above: the rows at a range's upper end follow the last row of the range above.
    places = let(own, lambda b: F.array_compact(F.array(
        place(b, False), F.when(F.try_element_at(longs(cuts), b + 1) == key, place(b + 1, True)), F.when(key == F.lit(most if most is not None else LEAST), place(F.lit(0), True)))))
    at = fresh(documents, "_place")
    dealt = documents.drop("next").withColumn(at, F.explode(places)).repartition(F.col(at)["range"]).withColumns(computed or {})
    order = Window.partitionBy(F.col(at)["range"]).orderBy(F.col(at)["guest"], F.desc_nulls_last(identity), *ties)
    return dealt.withColumn("next", F.lead(F.struct(*carried)).over(order)).where(~F.col(at)["guest"]).drop(at)
