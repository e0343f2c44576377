"""Token counts by an exact histogram of encoded lengths.

Documents are encoded once and only their lengths are kept. The histogram has
one row for each length; sums over its suffixes answer totals, quantiles and
truncated totals for every context limit without another look at a text.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import extend, shipped

shipped(__name__)

#: Lengths of a block of the histogram: suffix sums go over blocks, then inside each.
BLOCK = 4096
#: How patterns must end for long white space to be known as one piece, and what they take for white space.
TAIL = r"\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of white space in a row from which the pattern isn't asked: looking back over many more overflows its stack.
LONG = 100_000


def counter(file, pattern):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.value.splitlines())}
    encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    blank = re.compile(f"[{SPACE}]{{{LONG},}}")

    def count(text: str) -> int:
        if len(text) < LONG or not pattern.endswith(TAIL):
            return len(encoding.encode_ordinary(text))
        tokens, at = 0, 0
        for run in blank.finditer(text):
            # White space is one piece but for its last character where a word follows.
            end = run.end() - (run.end() < len(text))
            tokens += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end].encode()))
            at = end
        return tokens + len(encoding.encode_ordinary(text[at:]))

    return lambda texts: [pa.array([count(t) for t in texts], pa.int64())]


def with_lengths(documents: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``documents`` with ``n_tokens`` (long): the length of the text under the byte-level ranks at ``path``.

    Null and empty texts have 0; long white space is counted apart, with the same
    result. Rows that repeat stay; a column named ``n_tokens`` is replaced; no
    rows give no rows.
    """
    with open(path, "rb") as f:
        file = documents.sparkSession.sparkContext.broadcast(f.read())
    return extend(documents, text, {"n_tokens": T.LongType()}, counter, file, pattern)


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """length, n_docs: one row for each length that occurs (null lengths count as 0)."""
    return lengths.groupBy(F.coalesce(F.col(column), F.lit(0)).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def context_table(hist: DataFrame) -> DataFrame:
    """For each length L of ``hist`` (length, n_docs), as the limit:

    docs_from, tokens_from: documents of length L or more, and their tokens;
    tokens_total: of all; truncated_total: tokens left when every document is
    cut to L; share_within: part of the documents that L doesn't cut.
    An empty histogram gives no rows.
    """
    h = hist.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    down = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    whole = Window.partitionBy()
    sums = sums.select("block", *[F.coalesce(F.sum(c).over(down), F.lit(0)).alias(f"{c}_above") for c in "dt"], F.sum("d").over(whole).alias("docs_total"), F.sum("t").over(whole).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(sums, "block").withColumns({
        "docs_from": F.sum("n_docs").over(inside) + F.col("d_above"), "tokens_from": F.sum("n_tokens").over(inside) + F.col("t_above")})
    return h.select(
        "length", "n_docs", "n_tokens", "docs_from", "tokens_from", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"),
        (1 - (F.col("docs_from") - F.col("n_docs")) / F.col("docs_total")).alias("share_within"))


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, tokens, docs_cut for any limits, each once, also those that are no document's length; an empty histogram has zeros."""
    if not limits:
        return hist.sparkSession.createDataFrame([], "limit long, tokens long, docs_cut long")
    asked = F.explode(F.array(*[F.lit(x).cast("long") for x in sorted({int(x) for x in limits})])).alias("limit")
    none = hist.sparkSession.range(1).select(F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("n_docs"))
    rows = hist.select(F.col("length").cast("long").alias("length"), F.col("n_docs").cast("long").alias("n_docs")).unionByName(none)
    return rows.select("length", "n_docs", asked).groupBy("limit").agg(
        F.sum(F.least("length", "limit") * F.col("n_docs")).alias("tokens"), F.sum(F.when(F.col("length") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"))


def quantile(hist: DataFrame, share: float) -> DataFrame:
    """length: the shortest length within which at least ``share`` of the documents lie; no row for an empty histogram."""
    return context_table(hist).where(F.col("share_within") >= share - 1e-12).agg(F.min("length").alias("length"))
