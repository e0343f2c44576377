"""Full-text search: postings, Boolean, phrase and proximity queries, weights and snippets.

The index is a DataFrame of postings (word, doc_id, position, flags). A query is
an expression of words; each word or phrase becomes a DataFrame of documents
with weight and first position, AND and OR become joins and aggregates over
documents, and NOT becomes an anti-join. Words are filtered before anything else
is, so that only their postings move.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word starts with one of these and goes on with the same or a hyphen. Both engines read the expression alike.
STARTS = r"0-9@A-Za-z_\x{80}-\x{10FFFF}"
WORD = f"[{STARTS}][{STARTS}-]*"
LONGEST, NEAR = 40, 5
# What an occurrence in text of class 1 (medium) or 2 (greatest) weighs beside the 1 of any occurrence.
EMPHASIS = {1: 10, 2: 100}


@dataclass(frozen=True)
class System:
    """A full-text system: words are cut to ``longest`` characters, stop words keep their position but have no postings."""

    stop_words: frozenset[str] = frozenset()
    word: str = WORD
    longest: int = LONGEST
    near: int = NEAR


def postings(documents: DataFrame, system: System = System(), identity: str = "doc_id", text: str = "text", parts: dict[str, int] | None = None) -> DataFrame:
    """word (lower case), doc_id, position (from 0), first_upper, all_upper; a null text has none.

    parts: text columns in their order and the class of each (0, 1 or 2) in
    place of ``text``; positions go on from part to part, and ``emphasis`` is
    the class of each occurrence.
    """
    found = [F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(system.word), F.lit(0)) for c in parts or {text: 0}]
    if parts:
        classed = lambda k: lambda x: F.struct(x.alias("w"), F.lit(k).alias("emphasis"))
        found = [F.transform(w, classed(k)) for w, k in zip(found, parts.values(), strict=True)]
        rows = documents.select(F.col(identity).alias("doc_id"), F.posexplode(F.concat(*found)).alias("position", "_part")).select("doc_id", "position", F.col("_part.w").alias("_raw"), "_part.emphasis")
    else:
        rows = documents.select(F.col(identity).alias("doc_id"), F.posexplode(found[0]).alias("position", "_raw"))
    raw = F.left("_raw", F.lit(system.longest))
    head, rest = F.left("_raw", F.lit(1)), F.substring("_raw", F.lit(2), F.lit(system.longest))
    rows = rows.select(
        F.lower(raw).alias("word"), "doc_id", "position",
        (F.upper(head).eqNullSafe(head) & (F.lower(head) != head)).alias("first_upper"), ((F.upper(raw) == raw) & (F.lower(raw) != raw) & (F.length(rest) > 0)).alias("all_upper"), *(["emphasis"] if parts else []))
    return rows.where(~F.col("word").isin(sorted(system.stop_words))) if system.stop_words else rows


def occurrence_weight(index: DataFrame) -> Column:
    """1, and more in text of a class where the index knows classes."""
    if "emphasis" not in index.columns:
        return F.lit(1)
    more = F.lit(0)
    for k, w in EMPHASIS.items():
        more = F.when(F.col("emphasis") == k, w).otherwise(more)
    return more + 1


def word_table(index: DataFrame) -> DataFrame:
    """word, n_docs, n."""
    return index.groupBy("word").agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n"))


def remove_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def add_documents(index: DataFrame, documents: DataFrame, system: System = System()) -> DataFrame:
    """Postings of ``documents`` in place of those that they had."""
    return remove_documents(index, documents.select("doc_id")).unionByName(postings(documents, system))


# Queries


@dataclass(frozen=True)
class Node:
    kind: str  # word, phrase, near, and, or, not
    words: tuple[str, ...] = ()
    parts: tuple = field(default=())
    cased: bool = False


TOKEN = re.compile(r'\s*(?:(?P<phrase>"[^"]*")|(?P<open>\()|(?P<close>\))|(?P<word>=?[^\s()"]+)|(?P<open_quote>"))')


def parse(query: str) -> Node:
    """OR binds weakest, then AND, then NOT; words side by side are near each other, quoted ones in order."""
    tokens = [(m.lastgroup, m[m.lastgroup]) for m in TOKEN.finditer(query)]
    if any(kind == "open_quote" for kind, _ in tokens):
        raise ValueError("a quote is not closed")
    at = 0

    def peek(*words):
        return at < len(tokens) and tokens[at][0] == "word" and tokens[at][1].upper() in words

    def disjunction():
        nonlocal at
        parts = [conjunction()]
        while peek("OR"):
            at += 1
            parts.append(conjunction())
        return parts[0] if len(parts) == 1 else Node("or", parts=tuple(parts))

    def conjunction():
        nonlocal at
        parts = [negation()]
        while peek("AND"):
            at += 1
            parts.append(negation())
        return parts[0] if len(parts) == 1 else Node("and", parts=tuple(parts))

    def negation():
        nonlocal at
        if peek("NOT"):
            at += 1
            return Node("not", parts=(negation(),))
        return run()

    def run():
        nonlocal at
        if at >= len(tokens):
            raise ValueError("a word is missing at the end of the query")
        kind, value = tokens[at]
        if kind == "open":
            at += 1
            inner = disjunction()
            if at >= len(tokens) or tokens[at][0] != "close":
                raise ValueError("a parenthesis is not closed")
            at += 1
            return inner
        if kind == "close" or peek("AND", "OR", "NEAR"):
            raise ValueError(f"a word is missing before {value}")
        if kind == "phrase":
            at += 1
            return Node("phrase", tuple(value[1:-1].lower().split()))
        words = []
        while at < len(tokens) and tokens[at][0] == "word" and not peek("AND", "OR", "NOT"):
            if not peek("NEAR"):
                words.append(tokens[at][1])
            at += 1
        if len(words) == 1:
            cased = words[0].startswith("=")
            return Node("word", (words[0].lstrip("="),) if cased else (words[0].lower(),), cased=cased)
        return Node("near", tuple(w.lstrip("=").lower() for w in words))

    found = disjunction()
    if at < len(tokens):
        raise ValueError(f"the query ends before {tokens[at][1]}")
    return pushed(found)


def pushed(node: Node, negated: bool = False) -> Node:
    """NOT only at the leaves: AND and OR change places under it."""
    if node.kind == "not":
        return pushed(node.parts[0], not negated)
    if node.kind in ("and", "or"):
        kind = {"and": "or", "or": "and"}[node.kind] if negated else node.kind
        return Node(kind, parts=tuple(pushed(p, negated) for p in node.parts))
    return Node("not", parts=(node,)) if negated else node


def write_index(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Postings written in the order of words: a query then reads the files and row groups of its words alone."""
    index.repartitionByRange("word", "doc_id").sortWithinPartitions("word", "doc_id", "position").write.mode(mode).parquet(path)


PROPERTY = "quern.fulltext"


def stored_system(spark: SparkSession, name: str) -> tuple[DataFrame, System, DataFrame | None]:
    """Postings, rules and ids of the documents of a system that CREATE FULLTEXT made."""
    kept = json.loads({r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}[PROPERTY])
    ids = None
    for table, identity, _ in kept["items"]:
        one = spark.table(table).select(F.col(identity).alias("doc_id"))
        ids = one if ids is None else ids.union(one)
    return spark.table(name), System(word=kept["word"]), ids


def store(spark: SparkSession, name: str, word: str, items: list[list[str]]) -> None:
    """(Re)writes the table ``name`` of the postings of (table, id column, text expression) items, in the order of words."""
    index = None
    for table, identity, text in items:
        one = postings(spark.table(table).select(F.col(identity).alias("doc_id"), F.expr(text).alias("text")), System(word=word))
        index = one if index is None else index.union(one)
    if index is None:
        index = spark.createDataFrame([], "word string, doc_id bigint, position int, first_upper boolean, all_upper boolean")
    kept = json.dumps({"word": word, "items": items}).replace("\\", "\\\\").replace("'", "\\'")
    index.repartitionByRange("word", "doc_id").sortWithinPartitions("word", "doc_id", "position").write.format("parquet").mode("overwrite").saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{PROPERTY}' = '{kept}')")


def occurrence(node: Node, system: System) -> Column:
    """Whether a posting is one of the word that ``node`` is."""
    word = node.words[0]
    hit = F.col("word") == word.lower()[: system.longest]
    if node.cased and word != word.lower() and word == word.upper() and len(word) > 1:
        return hit & F.col("all_upper")
    if node.cased and word[:1] != word[:1].lower():
        return hit & F.col("first_upper")
    return hit


def single_words(node: Node) -> list[Node] | None:
    """The words of a query without phrases, neighbourhoods and negations alone; None for others."""
    if node.kind == "word":
        return [node]
    if node.kind == "and":
        parts = [p.parts[0] if p.kind == "not" else p for p in node.parts]
        wanted = any(p.kind != "not" for p in node.parts)
    elif node.kind == "or":
        parts, wanted = list(node.parts), all(p.kind != "not" for p in node.parts)
    else:
        return None
    found = [single_words(p) for p in parts]
    return sum(found, []) if wanted and all(f is not None for f in found) else None


def counted_search(index: DataFrame, node: Node, words: list[Node], system: System) -> DataFrame:
    """A query of single words in one pass: each document's occurrences of all words are one aggregate."""
    each = list(dict.fromkeys(words))
    hits, weighs = [occurrence(w, system) for w in each], occurrence_weight(index)
    every = hits[0]
    for h in hits[1:]:
        every = every | h
    sums = [e for k, h in enumerate(hits) for e in (F.sum(F.when(h, weighs).otherwise(0)).alias(f"_n{k}"), F.min(F.when(h, F.col("position"))).alias(f"_p{k}"))]
    rows = index.where(every).groupBy("doc_id").agg(*sums)

    def answer(n: Node) -> tuple[Column, Column, Column]:
        """Whether a document answers, its weight and position; the last two are null if not."""
        if n.kind == "word":
            k = each.index(n)
            return F.col(f"_n{k}") > 0, F.when(F.col(f"_n{k}") > 0, F.col(f"_n{k}")), F.col(f"_p{k}")
        parts = [(p.kind == "not", *answer(p.parts[0] if p.kind == "not" else p)) for p in n.parts]
        some = [p for p in parts if not p[0]]
        least = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0]
        greatest = lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0]
        held = F.lit(n.kind == "and")
        for negated, h, _, _ in parts:
            h = ~h if negated else h
            held = held & h if n.kind == "and" else held | h
        weight = (least if n.kind == "and" else greatest)([p[2] for p in some])
        return held, F.when(held, weight), F.when(held, least([p[3] for p in some]))

    held, weight, position = answer(node)
    return rows.where(held).select("doc_id", weight.alias("weight"), position.alias("position"))


def leaf(index: DataFrame, node: Node, system: System) -> DataFrame:
    """doc_id, weight, position of a word, phrase or neighbourhood; weights are of the occurrences of the first word."""
    if node.kind == "word":
        hits = index.where(occurrence(node, system)).select("doc_id", "position", occurrence_weight(index).alias("_w"))
    else:
        words = [w[: system.longest] for w in node.words]
        gaps, kept = [], []
        for k, w in enumerate(words):
            if w not in system.stop_words:
                kept.append(w)
                gaps.append(k)
        if not kept:
            return index.limit(0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("weight"), F.min("position").alias("position"))
        hits = index.where(F.col("word") == kept[0]).select("doc_id", "position", occurrence_weight(index).alias("_w"))
        for k, w in enumerate(kept[1:], 1):
            other = index.where(F.col("word") == w).select("doc_id", F.col("position").alias("_p"))
            if node.kind == "phrase":
                other = other.withColumn("position", F.col("_p") - (gaps[k] - gaps[0])).drop("_p")
                hits = hits.join(other, ["doc_id", "position"], "left_semi")
            else:
                near = (hits["doc_id"] == other["doc_id"]) & F.col("_p").between(F.col("position") - system.near, F.col("position") + system.near) & (F.col("_p") != F.col("position"))
                hits = hits.join(other, near, "left_semi")
    return hits.groupBy("doc_id").agg(F.sum("_w").alias("weight"), F.min("position").alias("position"))


def search(index: DataFrame, query: str | Node, system: System = System(), documents: DataFrame | None = None) -> DataFrame:
    """doc_id, weight, position of the documents that answer ``query``; AND takes the least weight, OR the greatest.

    documents: needed where a part of the query is only a negation; those have weight 0.
    """
    node = parse(query) if isinstance(query, str) else query
    if words := single_words(node):
        return counted_search(index, node, words, system)
    if node.kind == "not":
        if documents is None:
            raise ValueError("a negation alone needs the documents")
        found = search(index, node.parts[0], system, documents)
        return documents.select("doc_id").distinct().join(found, "doc_id", "left_anti").select("doc_id", F.lit(0).cast("long").alias("weight"), F.lit(None).cast("int").alias("position"))
    if node.kind == "or":
        parts = [search(index, p, system, documents) for p in node.parts]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("doc_id").agg(F.max("weight").alias("weight"), F.min("position").alias("position"))
    if node.kind == "and":
        wanted, unwanted = [p for p in node.parts if p.kind != "not"], [p for p in node.parts if p.kind == "not"]
        if not wanted:
            wanted, unwanted = [unwanted[0]], unwanted[1:]
        every = search(index, wanted[0], system, documents)
        for p in wanted[1:]:
            every = every.unionByName(search(index, p, system, documents))
        met = every.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.min("weight").alias("weight"), F.min("position").alias("position")).where(F.col("_n") == len(wanted)).drop("_n")
        for p in unwanted:
            met = met.join(search(index, p.parts[0], system, documents), "doc_id", "left_anti")
        return met
    return leaf(index, node, system)


def snippet(text: Column, position: Column, before: int = 5, after: int = 5, start: str = "[", end: str = "]", system: System = System(), count: int = 1) -> Column:
    """The words around a position, the ``count`` words from there on marked as one."""
    words = F.regexp_extract_all(text, F.lit(system.word), F.lit(0))
    first = F.greatest(position - before, F.lit(0))
    around = F.slice(words, first + 1, F.lit(before + count + after) - (first - (position - before)))
    last = F.least(position + count, F.size(words)) - 1
    mark = lambda w, k: F.concat(F.when(k + first == position, F.lit(start)).otherwise(""), w, F.when(k + first == last, F.lit(end)).otherwise(""))
    return F.array_join(F.transform(around, mark), " ")


def contexts(found: DataFrame, documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """``found`` with ``context``, the snippet at each answer's position in the document of its id."""
    texts = documents.select("doc_id", F.col(text).alias("_text"))
    return found.join(texts, "doc_id").withColumn("context", snippet(F.col("_text"), F.col("position"), **options)).drop("_text")
