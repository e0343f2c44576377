"""Mixing sources to target weights.

Sizes are summed per source (partial sums first, so that a source with a third
of all rows costs one row per task). Targets fill up like water: every source
gets ``level * weight`` until it meets its ceiling, and the level is where the
targets reach the wanted total. A document of a source is then taken
floor(rate) times, and once more with the fraction as its probability, decided
by a hash of the document, so that reruns agree.

Independent draws would miss the target of a source of few or uneven documents
by chance. So the extra copies are drawn in classes of like size: a class of n
documents gets n times the fraction of them, rounded up or down by one hashed
start for each source that runs on from class to class, and these are its
documents of the least hashes. Each document's probability is the fraction
exactly, whatever its size, and the words of a source come near its target. The
cut of a class is one hash, so a document needs no other one to be decided:
texts are neither sorted nor moved.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import chance, fresh, let, longs, materialize, scope

SEED = 1000
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Classes of size for each doubling; bits of a draw that number its bin while a cut is looked for.
CLASSES, BIN_BITS = 8, 12


def ranked(sums: DataFrame) -> DataFrame:
    """``sums`` (source, ...) with ``place``: the number of each source in code-point order from 0, null last.

    Sources are dealt into ranges and numbered range by range; the driver
    receives one number a range.
    """
    last = F.col("source").isNull()
    ranges = materialize(sums.repartitionByRange(last, "source").withColumn("_range", F.spark_partition_id()))
    held = {r[0]: r[1] for r in ranges.groupBy("_range").count().collect()}
    starts = [0, *accumulate(held.get(i, 0) for i in range(max(held, default=0) + 1))]
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(last, "source"))
    return ranges.withColumn("place", F.element_at(longs(starts), F.col("_range") + 1) + inside - 1).drop("_range")


def source_targets(sizes: DataFrame, share: float = 1.5, ceiling: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: one row for each source of ``sizes`` (source, size), written to the shared folder.

    The targets add up to ``share`` of all sizes and stop at ``ceiling`` times
    the source's size; the excess goes to the others by weight until none is
    above. A null source is one source, the last. The level is found in a few
    passes over the sources' sums, each of which closes all sources that the
    level so far lifts above their ceiling.
    """
    sums = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = materialize(ranked(sums).select("source", "source_size", weight.alias("weight")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, closed = 0.0, -1
    while True:
        full = F.col("source_size") * ceiling <= level * F.col("weight")
        n, below, open_ = s.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == closed or open_ is None:
            break
        closed, level = n, (share * total - ceiling * (below or 0)) / open_
    target = F.when(full, F.col("source_size") * ceiling).otherwise(F.least(level * F.col("weight"), F.col("source_size") * ceiling))
    return materialize(s.select("source", "source_size", target.alias("target")))


def size_class(size: Column) -> Column:
    """Documents of one class differ in size by less than a tenth. The size, which may be long to count, is asked once."""
    return F.coalesce(let(size, lambda n: F.when(n > 0, F.floor(F.log2(n.cast("double")) * CLASSES)).otherwise(-1).cast("int")), F.lit(-1))


def draw_number(draw: Column) -> Column:
    """63 hashed bits of what a document's draw depends on."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), draw), 1)


def plan(sizes: DataFrame, share: float = 1.5, ceiling: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, class, source_size, target, rate, cut of each source and class of size, written to the shared folder.

    sizes: source (string), size (long), draw (long, what a document's draw
    depends on). cut: documents of the class whose number is not above it get
    the extra copy.
    """
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.class") == F.col(f"{b}.class"))
    with scope() as keep:
        targets = source_targets(sizes, share, ceiling, weights).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        number = draw_number(F.col("draw"))
        d = sizes.select("source", size_class(F.coalesce("size", F.lit(0))).alias("class"), number.alias("number")).withColumn("bin", F.shiftright("number", 63 - BIN_BITS).cast("int"))
        bins = materialize(d.groupBy("source", "class", "bin").agg(F.count(F.lit(1)).alias("n")))
        classes = bins.groupBy("source", "class").agg(F.sum("n").alias("n")).alias("c")
        classes = classes.join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "class", "n", "source_size", "target", "rate")
        # From the largest class down: what rounding adds in one class it takes from the next.
        along = Window.partitionBy("source").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, 0)
        reached = F.sum("n").over(along) * (F.col("rate") - F.floor("rate"))
        start = chance(SEED, F.col("source"))
        upto = lambda x: F.floor(x + start).cast("long")
        taken = upto(reached) - F.coalesce(F.lag(upto(reached)).over(Window.partitionBy("source").orderBy(F.desc("class"))), F.lit(0))
        classes = materialize(classes.withColumn("extra", F.least("n", taken)))
        # The bin in which a class is cut, then the document in that bin.
        up = Window.partitionBy("source", "class").orderBy("bin")
        some = classes.where("extra > 0 AND extra < n").select("source", "class", "extra")
        b = bins.alias("b").join(some.alias("s"), same("b", "s"))
        b = b.select("b.source", "b.class", "bin", "n", "extra").withColumn("upto", F.sum("n").over(up))
        b = materialize(b.where("upto >= extra AND upto - n < extra").select("source", "class", "bin", (F.col("extra") - F.col("upto") + F.col("n")).alias("wanted")))
        near = d.alias("d").join(b.alias("b"), same("d", "b") & (F.col("d.bin") == F.col("b.bin")))
        near = near.select("d.source", "d.class", "number", "wanted").withColumn("at", F.row_number().over(Window.partitionBy("source", "class").orderBy("number")))
        cuts = near.where("at = wanted").select("source", "class", F.col("number").alias("cut")).alias("k")
        p = classes.alias("c").join(cuts, same("c", "k"), "left")
        cut = F.when(F.col("extra") == 0, F.lit(-1)).when(F.col("extra") == F.col("n"), F.lit(2**63 - 1)).otherwise(F.col("cut"))
        return keep(materialize(p.select("c.source", "c.class", "source_size", "target", "rate", cut.cast("long").alias("cut"))))


def with_copies(documents: DataFrame, sources: DataFrame, source: str, size: Column, draw: Column) -> DataFrame:
    """``documents`` with source_size, target and ``copies`` (int, 0 or more).

    The plan's table has a row for each source and class of size: the planner
    broadcasts it after its written size, and joins by sorting where it is long.
    """
    p = sources.select(*[F.col(c).alias(f"_p_{c}") for c in sources.columns])
    d = documents.drop("source_size", "target", "copies")
    own = fresh(d, "_class")
    d = d.withColumn(own, size_class(size))
    copies = F.floor("_p_rate") + (draw_number(draw) <= F.col("_p_cut")).cast("int")
    d = d.join(p, d[source].eqNullSafe(F.col("_p_source")) & (F.col(own) == F.col("_p_class")))
    return d.withColumns({"source_size": F.col("_p_source_size"), "target": F.col("_p_target"), "copies": copies.cast("int")}).drop(own, *p.columns)


def document_sizes(documents: DataFrame, words, *, identity: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size (words), draw of each document; short rows, written to the shared folder."""
    return materialize(documents.select(F.col(identity).alias("doc_id"), F.col(source).alias("source"), words.cast("long").alias("size"), F.xxhash64(F.col(identity), F.col(text)).alias("draw")))


def mix(documents: DataFrame, words: Column, **targets) -> DataFrame:
    """``documents`` as often as the mix takes each: same columns, repeats as rows.

    words: column expression of a document's size. Null texts count as none and
    are then never short of their target. Rows of equal id and text share one
    draw: all of them get an extra copy or none. Columns of any name pass through.
    """
    sources = plan(document_sizes(documents, words), **targets)
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "source", words.cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("draw"))
    taken = with_copies(packed, sources, "source", F.col("size"), F.col("draw")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
