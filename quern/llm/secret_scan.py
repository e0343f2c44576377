"""Secret scans through a trigram inverted index.

Each rule's regular expression is read as a Boolean query: trigrams that every
match must contain, as alternatives of sets. Only trigrams that some query names
are indexed. Postings (trigram, text) of a set are intersected by or-ing one bit
for each trigram that a text has; texts with all bits are candidates, and only
there does the rule's expression run. A rule without mandatory trigrams scans
every text. Candidates are as exact as the expressions: the index drops no match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import add
from re import _constants as kind
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import fresh, let, materialize


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping; those whose group is shorter than ``least`` are dropped."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # All of a run's characters are in its match, so the least length can stand in the expression.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE

#: Alternatives of a query: the sets of trigrams of which one must be there whole. ANYTHING asks for none.
Query = tuple[frozenset, ...]
ANYTHING: Query = (frozenset(),)
MOST_STRINGS, MOST_SETS = 64, 64


def absorbed(sets) -> Query:
    """Without the sets that ask for more than another one."""
    least = []
    for s in sorted(set(sets), key=lambda s: (len(s), sorted(s))):
        if not any(t <= s for t in least):
            least.append(s)
    return tuple(least)


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_SETS:  # asking for less is still right
        return min(a, b, key=len)
    return absorbed(x | y for x in a for y in b)


def of_strings(strings: set[str]) -> Query:
    return absorbed(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def node(op, arg) -> tuple[set[str] | None, Query]:
    """All strings that the node matches, in lower case, if they are few; and its query."""
    if op is kind.LITERAL:
        return {chr(arg).lower()}, ANYTHING
    if op is kind.IN:
        chars = set()
        for o, a in arg:
            if o is kind.LITERAL:
                chars.add(chr(a).lower())
            elif o is kind.RANGE and a[1] - a[0] < 8:
                chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None, ANYTHING
        return (chars, ANYTHING) if len(chars) <= 8 else (None, ANYTHING)
    if op in (kind.AT, kind.ASSERT, kind.ASSERT_NOT):
        return {""}, ANYTHING
    if op is kind.SUBPATTERN:
        return sequence(arg[-1])
    if op is kind.BRANCH:
        parts = [sequence(p) for p in arg[1]]
        if all(p[0] is not None for p in parts) and len(found := set().union(*[p[0] for p in parts])) <= MOST_STRINGS:
            return found, ANYTHING
        asked = [both(q, of_strings(s)) if s is not None else q for s, q in parts]
        return None, absorbed(x for q in asked for x in q)
    if op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, query = sequence(inner)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, ANYTHING
        if least == 0:
            return None, ANYTHING
        return None, both(query, of_strings(strings)) if strings is not None else query
    return None, ANYTHING


def sequence(nodes) -> tuple[set[str] | None, Query]:
    current, query, whole = {""}, ANYTHING, True
    for op, arg in nodes:
        strings, asked = node(op, arg)
        if strings is not None and len(current) * len(strings) <= MOST_STRINGS:
            current = {a + b for a in current for b in strings}
            continue
        whole = False
        query = both(query, of_strings(current))
        current = strings if strings is not None else {""}
        query = both(query, asked)
    return (current, query) if whole else (None, both(query, of_strings(current)))


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams; every text (in lower case) with a match contains one set whole."""
    strings, query = sequence(parser.parse(pattern))
    return both(query, of_strings(strings)) if strings is not None else query


def postings(documents: DataFrame, identity: str, text: str, trigrams: list[str]) -> DataFrame:
    """trigram, identity: which texts contain which of the ``trigrams``, in lower case. Null texts have none."""
    held = F.transform(F.array(F.lower(F.coalesce(F.col(text), F.lit("")))), lambda low: F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(low, t)))[0]
    return documents.select(F.explode(held).alias("trigram"), F.col(identity))


def candidates(index: DataFrame, identity: str, queries: list[Query]) -> DataFrame:
    """identity, rules: the numbers of the queries (as bits) that the postings of ``index`` answer."""
    terms = [(t, n * MOST_SETS + k, 1 << b, (1 << len(s)) - 1, 1 << n) for n, q in enumerate(queries) for k, s in enumerate(q) for b, t in enumerate(sorted(s))]
    schema = "trigram string, which int, bit long, full long, rule long"
    asked = F.broadcast(index.sparkSession.createDataFrame(terms, schema))  # as many rows as the rules have trigrams
    met = index.join(asked, "trigram").groupBy(identity, "which", "full", "rule").agg(F.bit_or("bit").alias("has")).where("has = full")
    return met.groupBy(identity).agg(F.bit_or("rule").alias("rules"))


#: Values of a block of ``running``.
BLOCK = 256


def running(values: Column, op, first: int = 0) -> Column:
    """Running totals of an array of int under ``op``, whose neutral value is ``first``.

    An array can only grow by being copied, so totals run over blocks first and
    then inside each block: n values cost little more than n steps.
    """
    grown = lambda xs, start: F.aggregate(xs, F.array(start), lambda done, x: F.concat(done, F.array(op(F.element_at(done, -1), x))))

    def over(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        totals = lambda bs: grown(F.transform(bs, lambda b: F.aggregate(b, F.lit(first), op)), F.lit(first))
        joined = lambda bs: F.flatten(F.zip_with(bs, F.slice(totals(bs), F.lit(1), F.size(bs)), lambda b, t: F.slice(grown(b, t), F.lit(2), F.size(b))))
        return F.when(F.size(v) > 0, let(blocks, joined)).otherwise(F.array().cast("array<int>"))

    return let(values, over)


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of a rule's matches: start, number, end in code points, end exclusive, and the same in bytes.

    Splitting at the matches gives what lies between them; the lengths of both add up to positions.
    """
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    sized = lambda w, b: F.struct(
        (F.char_length(b) + F.char_length(w)).alias("step"), (F.octet_length(b) + F.octet_length(w)).alias("byte_step"), F.char_length(w).alias("size"), F.octet_length(w).alias("bytes"))

    def placed(steps: Column) -> Column:
        ends = F.zip_with(running(F.transform(steps, lambda s: s["step"]), add), running(F.transform(steps, lambda s: s["byte_step"]), add), lambda a, b: F.struct(a.alias("end"), b.alias("byte")))
        return F.zip_with(steps, ends, lambda s, e: F.struct(
            (e["end"] - s["size"]).alias("start"), F.lit(number).alias("rule"), e["end"].alias("end"), (e["byte"] - s["bytes"]).alias("from_byte"), e["byte"].alias("to_byte")))

    spans = let(F.filter(F.zip_with(whole, between, sized), lambda s: s["size"].isNotNull()), placed)
    kept = F.filter(F.zip_with(spans, part, lambda s, p: F.struct(s.alias("span"), (F.char_length(p) >= rule.least).alias("kept"))), lambda s: s["kept"])
    return F.transform(kept, lambda s: s["span"]).cast(SPANS)


SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "rule", "end", "from_byte", "to_byte")]))


def scan(documents: DataFrame, identity: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``documents`` with ``spans``: array of (start, rule number, end, from_byte, to_byte) by start, then rule.

    Null and empty texts have no spans; rows that repeat have the same ones; no
    rows give no rows; a column named ``spans`` is replaced.
    """
    documents = documents.drop("spans")
    key, mask = fresh(documents, "_row"), fresh(documents, "_rules")
    keyed = documents.withColumn(key, F.xxhash64(F.col(identity), F.col(text)))
    queries = [trigram_query(r.pattern) for r in rules]
    indexed = [n for n, q in enumerate(queries) if q != ANYTHING]
    vocabulary = sorted({t for n in indexed for s in queries[n] for t in s})
    none = F.array().cast(SPANS)
    whole = F.coalesce(F.col(text), F.lit(""))
    if indexed:
        found = candidates(postings(keyed, key, text, vocabulary), key, [q if n in indexed else () for n, q in enumerate(queries)])
        # Written, so that the planner knows how many there are: few are broadcast and no text moves.
        keyed = keyed.join(materialize(found.select(F.col(key), F.col("rules").alias(mask))), key, "left")
    else:
        keyed = keyed.withColumn(mask, F.lit(None).cast("long"))
    parts = []
    for n, r in enumerate(rules):
        asked = F.coalesce(F.col(mask), F.lit(0)).bitwiseAND(F.lit(1 << n)) != 0 if n in indexed else whole.rlike(r.pattern)
        parts.append(F.when(asked, rule_spans(whole, r, n)).otherwise(none))
    return keyed.withColumn("spans", F.array_sort(F.concat(*parts))).drop(key, mask)


def named(spans: Column, rules: tuple[Rule, ...] = RULES, most: int | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined; only of the first ``most`` rules if given."""
    names = F.array(*[F.lit(r.name) for r in rules])
    chosen = F.filter(spans, lambda s: s["rule"] < most) if most is not None else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(names, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rule"] == number)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``; null stays null.

    The bytes between runs are cut out once each and joined by the mark.
    """
    def changed(s: Column) -> Column:
        data, found = s["data"], s["spans"]
        reached = F.concat(F.array(F.lit(0)), running(F.transform(found, lambda x: x["to_byte"]), lambda a, b: F.greatest(a, b)))
        gaps = F.zip_with(reached, F.concat(F.transform(found, lambda x: x["from_byte"]), F.array(F.octet_length(data))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.array_join(F.transform(F.filter(gaps, lambda g: g["b"] >= g["a"]), lambda g: F.decode(F.substring(data, g["a"] + 1, g["b"] - g["a"]), "UTF-8")), mark)

    return F.when(F.size(spans) > 0, let(F.struct(F.encode(text, "UTF-8").alias("data"), spans.alias("spans")), changed)).otherwise(text)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The base form, every rule over every text, in the other engine's SQL over ``documents``."""
    quoted = lambda r: "'" + r.pattern.replace("'", "''") + "'"
    length = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    parts = []
    for n, r in enumerate(rules):
        parts.append(f"""
            SELECT doc_id, {n} AS rule, '{r.name}' AS kind, {length('b[1:i]')} + {length('w[1:i - 1]')} AS start, length(w[i]) AS size
            FROM (SELECT doc_id, b, w, p, unnest(range(1, len(w) + 1)) AS i FROM
                  (SELECT doc_id, regexp_extract_all(text, {quoted(r)}, 0) AS w, regexp_extract_all(text, {quoted(r)}, {r.group}) AS p, regexp_split_to_array(text, {quoted(r)}) AS b
                   FROM documents WHERE regexp_matches(text, {quoted(r)})) m) s WHERE length(p[i]) >= {r.least}""")
    joined = lambda where: f"coalesce(string_agg(concat(kind, ':', start, ':', start + size), ',' ORDER BY start, rule) FILTER ({where}), '')"
    counts = ", ".join(f"count(*) FILTER (rule = {n}) AS n_{r.name}" for n, r in enumerate(rules[: len(BASE)]))
    return f"""
        WITH hits AS ({' UNION ALL '.join(parts)})
        SELECT d.doc_id, {counts}, sha256({joined(f'rule < {len(BASE)}')}) AS base_sha256, {joined('rule IS NOT NULL')} AS spans
        FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id GROUP BY d.doc_id"""
