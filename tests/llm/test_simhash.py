import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.queries import op3_simhash


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, radius):
    """items: (id, number)."""
    up = list(range(len(items)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (d, _) in enumerate(items):
        if d is not None:
            least[root(k)] = min(least.get(root(k), d), d)
    return [least.get(root(k)) for k in range(len(items))]


def check(rows, docs):
    items = [(d, brute_fingerprint(t)) for d, t in docs]
    expected = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(items, brute_components(items, 2), strict=True)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=str) == expected


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    check(op3_simhash(spark, d).collect(), docs)


def test_nulls_ties_repeats_and_empty_tables(spark):
    docs = [(5, None), (3, ""), (9, "a b"), (9, "a b"), (None, "A B"), (7, " \t\n"), (4, "one two three four"), (2, "ONE two\x0bthree  four"), (None, "quite alone here today"), (1, "Ünïcode \xa0words ÄÖ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(simhash.with_components(df).collect(), docs)
    assert simhash.with_components(df.where("false")).count() == 0


@pytest.mark.parametrize(("lanes", "radius"), [(1, 2), (1, 0), (1, 5), (4, 40)])
def test_bit_sliced_links_connect_what_brute_force_does(lanes, radius):
    rng = random.Random(radius)
    size = 64 * lanes
    numbers = set()
    for _ in range(60):
        seed = rng.getrandbits(size)
        numbers.add(seed)
        for _ in range(rng.choice([0, 1, 5, 60])):
            seed ^= sum({1 << rng.randrange(size) for _ in range(rng.randint(0, radius + 2))})
            numbers.add(seed)
    numbers = sorted(numbers)
    rng.shuffle(numbers)
    cuts = sorted(rng.sample(range(1, len(numbers)), 12))
    buckets = [numbers[a:b] for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True)]
    for limit in (256, 8):
        simhash.LARGE = limit
        for bucket in buckets:
            bits = simhash.bits_of([n.to_bytes(size // 8) for n in bucket])
            forest = simhash.Forest(len(bucket))
            if len(bucket) > limit:
                simhash.link_large(bits, 0, radius, forest)
            elif len(bucket) > 1:
                simhash.link_small(bits, [len(bucket)], radius, forest)
            if len(bucket) <= limit:  # larger ones have stars of whole components
                assert all((bucket[a] ^ bucket[b]).bit_count() <= radius for a, b in forest.edges)
            expected = brute_components([(k, n) for k, n in enumerate(bucket)], radius)
            least = {}
            for k in range(len(bucket)):
                least.setdefault(forest.root(k), k)
            assert [least[forest.root(k)] for k in range(len(bucket))] == expected
    simhash.LARGE = 256


def test_hot_buckets_are_divided_without_loss(spark, monkeypatch):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(5)]
    numbers = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(60)}
    monkeypatch.setattr(simhash, "HOT", 10)
    fps = spark.createDataFrame([(bytearray(n.to_bytes(8)),) for n in numbers], "fp binary")
    roots = {bytes(r.node): bytes(r.root) for r in simhash.components(simhash.linked(fps, 2, 3)).collect()}
    items = sorted(numbers)
    expected = brute_components(list(enumerate(items)), 2)
    classes = {}
    for k, n in enumerate(items):
        classes.setdefault(expected[k], set()).add(n)
    got = {}
    for n in numbers:
        got.setdefault(roots.get(n.to_bytes(8), n.to_bytes(8)), set()).add(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_deduplication_finds_near_copies_and_keeps_the_rest(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    docs, origin = [], {}
    for d in range(120):
        text = [rng.choice(words) for _ in range(rng.choice([40, 200, 1500]))]
        docs.append((d, " ".join(text)))
        if d < 60:
            for c in range(2):
                changed = list(text)
                for _ in range(len(text) // 80):
                    changed[rng.randrange(len(text))] = rng.choice(words)
                origin[1000 + 2 * d + c] = d
                docs.append((1000 + 2 * d + c, " ".join(changed).title() + "."))
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, fp string")
    kept = {r.doc_id for r in simhash.deduplicated(df).collect()}
    texts = dict(docs)
    alike = [c for c, o in origin.items() if len(shingles(texts[c]) & shingles(texts[o])) >= 0.8 * len(shingles(texts[c]) | shingles(texts[o]))]
    assert len(alike) > 50
    assert sum(c not in kept for c in alike) >= 0.9 * len(alike)
    assert kept >= set(range(120))
    assert simhash.deduplicated(df).columns == df.columns


def test_deduplication_of_awkward_rows(spark):
    text = "one two three four five six seven"
    rows = [(2, text), (1, text.upper() + "!"), (1, text), (None, text), (None, "no id of its own in here"), (None, "nor has this other one any"), (7, None), (8, ""), (9, " . ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit(1), "_copy": F.lit(2), "copy": F.lit(3)})
    kept = sorted(((r.doc_id, r.text) for r in simhash.deduplicated(df).collect()), key=str)
    assert [k for k in kept if k[0] is None] == [rows[4], rows[5]]
    assert len([k for k in kept if k[0] == 1]) == 1 and (2, text) not in kept and (None, text) not in kept
    assert [k for k in kept if k[0] in (7, 8, 9)] == [(7, None)]
    assert simhash.deduplicated(df.where("false")).count() == 0


def test_majority_counts_every_bit():
    h = np.array([0b11, 0b01, 0b01], np.uint64)
    assert simhash.majority(h, 1) == (1).to_bytes(8)
    assert simhash.majority(np.empty(0, np.uint64), 2) == bytes(16)


def kept_by_brute_force(docs, likeness=0.8):
    """Ids that stay, if each pair of different ids at this likeness is linked; all ids differ."""
    sets = [(d, shingles(t)) for d, t in docs]
    up = {d: d for d, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if len(a & b) / len(a | b) >= likeness:
                x, y = sorted((root(d), root(e)))
                up[y] = x
    return {root(d) for d in up}


def changed(rng, words, part):
    """The words with single ones replaced, about ``part`` of them, far apart: each breaks five shingles."""
    out = list(words)
    for i in range(3, len(out), int(1 / part)):
        out[i] = f"x{rng.getrandbits(40)}"
    return out


@pytest.mark.parametrize("texts", [256, 8])
def test_only_shingle_sets_alike_enough_are_near_copies(spark, monkeypatch, texts):
    monkeypatch.setattr(simhash, "TEXTS", texts)
    rng = random.Random(11)
    docs = []
    for k in range(12):
        base = [f"w{rng.getrandbits(30)}" for _ in range(300)]
        docs.append((100 * k, " ".join(base)))
        for c in range(1, 7):  # one replaced word in 20 to 90: likeness 0.6 to 0.9
            docs.append((100 * k + c, " ".join(changed(rng, base, 1 / rng.choice([25, 30, 35, 40, 90])))))
    line = [f"l{rng.getrandbits(30)}" for _ in range(19)]
    for d in (5000, 5001):  # one line many times over, and much that is their own
        docs.append((d, " ".join(line * 20 + [f"o{rng.getrandbits(40)}" for _ in range(64)])))
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    right = kept_by_brute_force(docs)
    assert right <= kept  # none goes without a partner
    assert {5000, 5001} <= right
    assert len(kept - right) <= 0.05 * (len(docs) - len(right))


def test_hot_buckets_of_wide_fingerprints(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.getrandbits(30)}" for _ in range(400)]
    docs = [(0, " ".join(base))] + [(d, " ".join(base[:k] + [f"x{d}"] + base[k + 1 :])) for d, k in enumerate(range(5, 395, 6), 1)]
    docs += [(1000 + d, " ".join(f"y{rng.getrandbits(40)}" for _ in range(100))) for d in range(30)]
    monkeypatch.setattr(simhash, "HOT", 10)
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == kept_by_brute_force(docs) == {0, *range(1000, 1030)}


def test_hot_wide_buckets_lose_no_pair(spark, monkeypatch):
    rng = random.Random(9)
    numbers = [rng.getrandbits(320) for _ in range(40)]
    numbers += [n ^ sum(1 << k for k in rng.sample(range(320), 50)) for n in numbers[:30]]
    family = rng.getrandbits(320)
    numbers += [family ^ 1 << k for k in range(40)]
    monkeypatch.setattr(simhash, "HOT", 10)
    rows = spark.createDataFrame([(7, bytearray(n.to_bytes(40))) for n in numbers], "key long, fp binary")
    roots = {bytes(r.node): bytes(r.root) for r in simhash.components(simhash.linked_in_buckets(rows, 53)).collect()}
    classes, got = {}, {}
    for n, c in zip(numbers, brute_components(list(enumerate(numbers)), 53), strict=True):
        classes.setdefault(c, set()).add(n)
        got.setdefault(roots.get(n.to_bytes(40), n.to_bytes(40)), set()).add(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))
    assert len(classes) == 41


def test_texts_of_marks_alone_meet_only_their_equals(spark):
    rows = [(1, "+++"), (2, "***"), (3, "+++"), (4, "\U0001f600 \U0001f680"), (5, "\U0001f680"), (6, "* * *"), (7, " *** "), (8, None), (9, ". ."), (10, "")]
    kept = sorted(r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [1, 2, 4, 5, 6, 8]


def test_verdicts_do_not_depend_on_the_other_documents(spark):
    rng = random.Random(3)
    docs = []
    for k in range(15):
        base = [f"w{rng.getrandbits(30)}" for _ in range(300)]
        docs += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(changed(rng, base, 1 / 38))), (10 * k + 2, " ".join(changed(rng, base, 1 / 90)))]
    more = [(1000 + d, " ".join(f"v{rng.getrandbits(12)}" for _ in range(60))) for d in range(2500)]
    kept = lambda rows: {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    alone, among = kept(docs), kept(docs + more)
    assert alone == {d for d in among if d < 1000} == kept_by_brute_force(docs) == {10 * k + c for k in range(15) for c in (0, 1)}
    assert {d for d, _ in more} <= among


def test_sets_meet_in_a_band_as_often_as_their_likeness_says():
    rng, found, n = random.Random(6), 0, 400
    for _ in range(n):
        both = [rng.getrandbits(64) for _ in range(240)]
        a, b = (np.unique(np.array(both + [rng.getrandbits(64) for _ in range(30)], np.uint64)) for _ in range(2))  # likeness 0.8
        found += bool(set(simhash.band_keys(a)) & set(simhash.band_keys(b)))
    assert found >= 0.98 * n
    assert len(simhash.band_keys(a)) == simhash.BANDS and simhash.band_keys(np.empty(0, np.uint64)) == [0]


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(bytearray(k.to_bytes(4)), bytearray((k + 1).to_bytes(4))) for k in range(300)], "u binary, v binary")
    roots = simhash.components(edges).collect()
    assert len(roots) == 301 and {bytes(r.root) for r in roots} == {bytes(4)}
