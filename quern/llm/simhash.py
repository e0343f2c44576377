"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are made by majority over the hashes of word shingles. Only
different fingerprints are compared, and only those that meet in a bucket. In
the narrow form buckets are bands of bits, one more than bits may differ, so that
no pair within the radius is missed. In the wide form, for texts that are alike
by their shingle sets, buckets are made of the sets' least hashes: strangers
hardly ever meet there, however many texts there are, so that widths, bands and
radius are the same at every size. What lies within the radius is then compared
by the shingle sets themselves.

Members of a bucket are stored by bit plane, 64 to a machine word. A query's bit
turns a plane into differences, which carry-save counters of three operations a
plane add up for 64 members at once; the counters start so high that passing the
radius overflows them. Words whose members have all overflowed are abandoned.
A task emits a spanning forest of the links that it finds, never all pairs, and
components of the forests are found by distributed star contraction.
"""

from __future__ import annotations

import math
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import extend, fresh, materialize, pieces, release, scope, shipped

shipped(__name__)

SEED = 42
#: Members of a bucket above which it is divided: by further bands (narrow form) or into blocks (wide form).
HOT = 16_384
#: Word pairs that are compared at a time; members from which a bucket is searched by itself; bits between two looks for words to abandon.
AT_ONCE, LARGE, LOOK = 1 << 19, 256, 8
#: Sets of a group of candidates that a task compares as one block.
TEXTS = 256
#: Words of 64 bits of a wide fingerprint, bands of a set's least hashes, and hashes of a band.
LANES, BANDS, LEAST = 5, 10, 4
#: What makes orders of a hash: a number to mix in, and an odd one to multiply by.
ORDERS = np.array([[xxhash.xxh64_intdigest(b"order", 2 * k), xxhash.xxh64_intdigest(b"order", 2 * k + 1) | 1] for k in range(BANDS * LEAST)], np.uint64).T


def plain_words(text: str) -> list[bytes]:
    """Between ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split()


def bare_words(text: str) -> list[bytes]:
    """Letters and digits alone, in lower case; in texts without any, what stands between white space.

    Full stops alone are no text.
    """
    words = re.findall(r"\w+", text.lower())
    if not words and text.strip(". \t\n\v\f\r"):
        return plain_words(text)
    return [w.encode() for w in words]


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each run of ``k`` words joined by a space, repeats included; fewer words are one run, none give none."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, SEED)], np.uint64)
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[k:], strict=False)], np.uint64)


def majority(hashes: np.ndarray, lanes: int) -> bytes:
    """Bits set in over half of the hashes, most significant first; further lanes mix the hash anew."""
    out = []
    for lane in range(lanes):
        h = mixed(hashes, lane)
        count = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 14):
            bits = np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            count += bits.sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * count > len(h)).tobytes())
    return b"".join(out)


def hasher(width: int):
    return lambda texts: [pa.array([majority(shingle_hashes(plain_words(t), width), 1) for t in texts], pa.binary())]


def fingerprints(documents: DataFrame, text: str = "text", width: int = 3, into: str = "fp") -> DataFrame:
    """``documents`` with the binary SimHash of 64 bits; null and empty texts have all bits zero."""
    return extend(documents, text, {into: T.BinaryType()}, hasher, width)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Ascending hashes of the different shingles of a text's bare words."""
    return np.unique(shingle_hashes(bare_words(text), width))


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The hashes hashed anew, differently for each lane; lane 0 leaves them."""
    if not lane:
        return hashes
    with np.errstate(over="ignore"):
        h = (hashes ^ np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band: what the set's least hashes are under ``LEAST`` orders. Sets of likeness j agree on a band with chance j ** LEAST."""
    if not len(hashes):
        return [0]
    least = np.full(BANDS * LEAST, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 1 << 12):
            least = np.minimum(least, ((hashes[i : i + (1 << 12), None] ^ ORDERS[0]) * ORDERS[1]).min(axis=0))
    return [xxhash.xxh64_intdigest(least[b * LEAST : (b + 1) * LEAST].tobytes(), b) - 2**63 for b in range(BANDS)]


def set_hasher(width: int):
    """The wide SimHash of each text's shingle set, a digest by which equal sets are known, and the set's band keys."""

    def compute(texts):
        sets = [shingle_set(t, width) for t in texts]
        return [
            pa.array([majority(h, LANES) for h in sets], pa.binary()), pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()),
            pa.array([band_keys(h) for h in sets], pa.list_(pa.int64()))]

    return compute


# Buckets


def bits_of(fps: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)


def banded(df: DataFrame, parts: int, level: int) -> DataFrame:
    """key, path, fp: each fingerprint once for each of ``parts`` bands of the bits that its path has not used yet.

    path: the bands chosen so far, as digits. key: what the chosen bands hold.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = batch.column("fp").to_pylist()
            bits = bits_of(fps)
            paths = batch.column("path").to_numpy(zero_copy_only=False) if level else np.zeros(len(fps), np.int64)
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64) if level else np.zeros(len(fps), np.uint64)
            for path in np.unique(paths):
                rows = np.nonzero(paths == path)[0]
                left = np.arange(bits.shape[1])
                for at in range(level - 1, -1, -1):
                    left = np.setdiff1d(left, np.array_split(left, parts)[int(path) // parts**at % parts])
                for b, band in enumerate(np.array_split(left, parts)):
                    if not len(band):
                        continue
                    new = int(path) * parts + b
                    with np.errstate(over="ignore"):
                        key = (keys[rows] + np.uint64(new + 1)) * np.uint64(0x9E3779B97F4A7C15)
                        for chunk in np.array_split(band, -(-len(band) // 60)):
                            value = bits[np.ix_(rows, chunk)] @ (1 << np.arange(len(chunk), dtype=np.int64))
                            key = (key ^ value.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                            key ^= key >> np.uint64(31)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(rows), new)), pa.array([fps[r] for r in rows], pa.binary())], names=["key", "path", "fp"])

    return df.mapInArrow(run, "key long, path long, fp binary")


# Bit-sliced comparison


class Planes:
    """Bit planes of members that lie in words of 64 lanes."""

    def __init__(self, bits: np.ndarray, lane: np.ndarray, words: int):
        spread = np.zeros((bits.shape[1], words * 64), np.uint8)
        spread[:, lane] = bits.T
        self.planes = np.packbits(spread, axis=1, bitorder="little").view("<u8")
        used = np.zeros(words * 64, np.uint8)
        used[lane] = 1
        self.used = np.packbits(used, bitorder="little").view("<u8")

    def within(self, query: np.ndarray, word: np.ndarray, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of a query (row of ``bits``) and a word: which pairs have members within the radius, and which lanes those are."""
        places = max(1, radius.bit_length())
        start = (1 << places) - 1 - radius
        count = [np.full(len(query), -(start >> p & 1) & (2**64 - 1), np.uint64) for p in range(places)]
        over, alive = ~self.used[word], np.arange(len(query))
        flip = (-bits.astype(np.int64)).view(np.uint64).T
        for b in range(bits.shape[1]):
            carry = self.planes[b][word] ^ flip[b][query]
            for p in range(places):
                carried = count[p] & carry
                count[p] ^= carry
                carry = carried
            over |= carry
            if b % LOOK == LOOK - 1:
                open_ = np.nonzero(~over)[0]
                if len(open_) < 0.75 * len(alive):
                    alive, over, query, word = alive[open_], over[open_], query[open_], word[open_]
                    count = [c[open_] for c in count]
        hit = np.nonzero(~over)[0]
        return alive[hit], ~over[hit]


def lanes_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and lane of every set bit."""
    return np.nonzero(np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little"))


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, pairs) -> None:
        for a, b in pairs:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.edges.append((a, b))


def link_small(bits: np.ndarray, sizes: list[int], radius: int, forest: Forest) -> None:
    """Buckets of 2 to ``LARGE`` members, one after another in ``bits``: each member against its bucket's words."""
    sizes = np.array(sizes)
    words = -(-sizes // 64)
    first_word, first = np.r_[0, np.cumsum(words)[:-1]], np.r_[0, np.cumsum(sizes)[:-1]]
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    lane = first_word[bucket] * 64 + np.arange(len(bits)) - first[bucket]
    planes = Planes(bits, lane, int(words.sum()))
    member = np.full(int(words.sum()) * 64, -1)
    member[lane] = np.arange(len(bits))
    query = np.repeat(np.arange(len(bits)), words[bucket])
    begin = np.repeat(np.r_[0, np.cumsum(words[bucket])[:-1]], words[bucket])
    word = first_word[bucket][query] + np.arange(len(query)) - begin
    ahead = word >= lane[query] // 64
    query, word = query[ahead], word[ahead]
    for i in range(0, len(query), AT_ONCE):
        q, w = query[i : i + AT_ONCE], word[i : i + AT_ONCE]
        hit, mask = planes.within(q, w, bits, radius)
        row, at = lanes_of(mask)
        a, b = q[hit[row]], member[w[hit[row]] * 64 + at]
        forest.link(zip(a[a < b].tolist(), b[a < b].tolist(), strict=True))


def link_large(bits: np.ndarray, base: int, radius: int, forest: Forest) -> None:
    """One bucket of any size: whole components while they are large, then all that is left against itself."""
    left = np.arange(len(bits))
    for _ in range(16):
        if len(left) <= LARGE:
            break
        n, found = len(left), grow(bits, left, radius)
        forest.link((base + int(left[0]), base + int(x)) for x in found if x != left[0])
        left = np.setdiff1d(left, found)
        if len(found) * 16 < n:
            break
    if len(left) < 2:
        return
    own = bits[left]
    n, words = len(left), -(-len(left) // 64)
    planes = Planes(own, np.arange(n), words)
    step = max(1, AT_ONCE // words)
    for i in range(0, n, step):
        rows = np.arange(i, min(i + step, n))
        query, word = np.repeat(rows, words), np.tile(np.arange(words), len(rows))
        ahead = word >= query // 64
        query, word = query[ahead], word[ahead]
        hit, mask = planes.within(query, word, own, radius)
        for j in range(0, len(hit), 1 << 14):  # 64 members at most for each
            row, at = lanes_of(mask[j : j + (1 << 14)])
            a, b = query[hit[j : j + (1 << 14)][row]], word[hit[j : j + (1 << 14)][row]] * 64 + at
            new = a < b
            forest.link(zip((base + left[a[new]]).tolist(), (base + left[b[new]]).tolist(), strict=True))


def grow(bits: np.ndarray, left: np.ndarray, radius: int) -> np.ndarray:
    """The component of ``left[0]`` among ``left``. What is found is not searched again: a tight group costs little."""
    found, front, rest = [left[:1]], left[:1], left[1:]
    while len(front) and len(rest):
        near = []
        words = -(-len(rest) // 64)
        planes = Planes(bits[rest], np.arange(len(rest)), words)
        step = max(1, min(64, AT_ONCE // words))
        gone = np.zeros(words * 64, bool)
        for i in range(0, len(front), step):
            rows = front[i : i + step]
            open_ = np.nonzero(planes.used)[0]
            if not len(open_):
                break
            query, word = np.repeat(np.arange(len(rows)), len(open_)), np.tile(open_, len(rows))
            hit, mask = planes.within(query, word, bits[rows], radius)
            together = np.zeros(words, np.uint64)
            np.bitwise_or.at(together, word[hit], mask)
            row, at = lanes_of(together)
            gone[row * 64 + at] = True
            planes.used = planes.used & ~together
            if i == 0 and gone.sum() * 2 > len(rest):
                # Most are found: go on with planes of the others alone.
                break
        done = min(i + step, len(front))
        near = rest[gone[: len(rest)]]
        found.append(near)
        front, rest = np.concatenate([front[done:], near]), rest[~gone[: len(rest)]]
    return np.concatenate(found)


def linker(radius: int):
    """From rows (key, fp) in the order of keys to edges (a, b) between fingerprints."""

    def edges(rows: list[tuple[list[bytes]]]):
        rows = [sorted(set(r)) for r in rows]
        small, large = [r for r in rows if 1 < len(r) <= LARGE], [r for r in rows if len(r) > LARGE]
        fps = [f for r in small + large for f in r]
        if not fps:
            return None
        bits, forest = bits_of(fps), Forest(len(fps))
        n = sum(map(len, small))
        if small:
            link_small(bits[:n], [len(r) for r in small], radius, forest)
        for r in large:
            link_large(bits[n : n + len(r)], n, radius, forest)
            n += len(r)
        # Of a component one star, from the least fingerprint: short ways for the contraction that follows.
        least: dict[int, bytes] = {}
        touched = {x for e in forest.edges for x in e}
        for x in touched:
            r = forest.root(x)
            least[r] = min(least.get(r, fps[x]), fps[x])
        pairs = {(fps[x], least[forest.root(x)]) for x in touched if fps[x] != least[forest.root(x)]}
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["u", "v"])

    def run(batches):
        key, bucket, waiting, held = None, [], [], 0
        for batch in batches:
            for k, fp in zip(batch.column("key").to_pylist(), batch.column("fp").to_pylist(), strict=True):
                if k != key:
                    if len(bucket) > 1:
                        waiting.append(bucket)
                        held += len(bucket)
                        if held >= 32_768:
                            if (made := edges(waiting)) is not None:
                                yield made
                            waiting, held = [], 0
                    key, bucket = k, []
                bucket.append(fp)
        if len(bucket) > 1:
            waiting.append(bucket)
        if waiting and (made := edges(waiting)) is not None:
            yield made

    return run


def link_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """u, v: edges between the fingerprints of each bucket (key, fp) that lie within the radius."""
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(linker(radius), "u binary, v binary")


def linked(fps: DataFrame, radius: int, parts: int, levels: int = 4) -> DataFrame:
    """u, v: edges between fingerprints (column fp, each once) that lie within the radius, enough to connect all that do.

    ``parts`` is ``radius + 1``. Buckets of over ``HOT`` members are divided by
    another band of the bits that are left, up to ``levels`` times. That loses
    nothing: the pairs of such a bucket agree on one of the new bands, too.
    """
    rows, found = banded(fps.select("fp"), parts, 0), []
    for level in range(1, levels + 1):
        if level == levels:
            found.append(rows)
            break
        hot = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"))
        if hot.isEmpty():
            found.append(rows)
            break
        found.append(rows.join(hot, "key", "left_anti"))
        rows = materialize(banded(rows.join(hot, "key", "left_semi").select("key", "path", "fp"), parts, level))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return link_buckets(every.select("key", "fp"), radius)


def linked_in_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """u, v: edges between fingerprints of a bucket (columns key, fp) that lie within the radius, enough to connect all that do.

    Buckets of over ``HOT`` members are compared whole, in blocks.
    """
    hot = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"))
    if hot.isEmpty():
        return link_buckets(rows, radius)
    whole = materialize(rows.join(hot, "key", "left_semi").select("key", F.col("fp").alias("node")))
    cold = link_buckets(rows.join(hot, "key", "left_anti"), radius)
    return cold.unionByName(exhaustive(whole, lambda df: link_buckets(df.withColumnRenamed("node", "fp"), radius), HOT))


# Whole comparison of large groups


def exhaustive(members: DataFrame, link, limit: int) -> DataFrame:
    """u, v: edges enough to connect all pairs of nodes of a key (columns key, node, each pair once) that ``link`` finds alike.

    link: from rows (key, node) to the edges inside each key. A key of over
    ``limit`` members is dealt into blocks that have one member, the pivot, in
    common. Members that come to hang together with it need no comparison with
    each other; all others are then compared with all members, a pair of blocks
    at a time. So a tight group costs two rows a member, whatever its size.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1")
    sizes = materialize(sizes.select("key", "pivot", F.ceil(F.col("n") / F.lit(limit)).alias("blocks")))
    dealt = materialize(members.join(sizes, "key").select("key", "node", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block")))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    large, pivots = dealt.where("blocks > 1"), sizes.where("blocks > 1")
    shared = pivots.select("key", F.col("pivot").alias("node"), numbers("blocks").alias("block"))
    rows = dealt.select("key", "node", "block").unionByName(shared).distinct()
    first = materialize(link(rows.select(F.xxhash64("key", "block").alias("key"), "node")))
    if pivots.isEmpty():
        return first
    roots = components(first).select(F.col("node").alias("_n"), "root")
    centre = pivots.join(roots, pivots.pivot == roots._n, "left").select("key", F.coalesce("root", "pivot").alias("centre"))
    apart = large.join(roots, large.node == roots._n, "left").select("key", "node", "blocks", F.coalesce("root", "node").alias("root"))
    apart = materialize(apart.join(centre, "key").where(F.col("root") != F.col("centre")).select("key", "node", "blocks"))
    if apart.isEmpty():
        return first
    few = materialize(apart.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(limit)).alias("others")))
    one = large.join(few, "key").select("key", "node", "block", numbers("others").alias("other"))
    two = apart.join(few, "key").select("key", "node", numbers("blocks").alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), "others").alias("other"))
    return first.unionByName(materialize(link(one.unionByName(two).distinct().select(F.xxhash64("key", "block", "other").alias("key"), "node"))))


def set_links(nodes: list[bytes], sets: list[np.ndarray], likeness: float) -> list[tuple[bytes, bytes]]:
    """A star for each component of the links between sets of at least this Jaccard likeness; every pair that could join two is compared."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.r_[0, np.cumsum(sizes)]
    held, made = np.zeros(len(codes), bool), []
    open_ = np.ones(len(sets), bool)
    for start in range(len(sets)):
        front = [start] if open_[start] else []
        open_[start] = False
        while front and open_.any():
            x = front.pop()
            own = codes[first[x] : first[x + 1]]
            held[own] = True
            both = np.bincount(owner[held[codes]], minlength=len(sets))
            held[own] = False
            near = np.nonzero(open_ & (both / np.maximum(sizes + sizes[x] - both, 1) >= likeness))[0]
            open_[near] = False
            front.extend(near.tolist())
            made.extend((nodes[n], nodes[start]) for n in near)
    return made


def set_linker(likeness: float):
    """From rows (key, node, hashes) in the order of keys to edges (u, v) between nodes whose shingle sets are alike enough."""

    def edges(bucket: dict[bytes, np.ndarray]):
        made = set_links(list(bucket), list(bucket.values()), likeness) if len(bucket) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.binary()) for i in (0, 1)], names=["u", "v"])

    def run(batches):
        key, bucket = None, {}
        for batch in batches:
            for small in pieces(batch):
                for k, node, packed in zip(*(small.column(c).to_pylist() for c in ("key", "node", "hashes")), strict=True):
                    if k != key:
                        yield edges(bucket)
                        key, bucket = k, {}
                    bucket[node] = np.frombuffer(packed, np.uint64)
        yield edges(bucket)

    return run


def set_packer(width: int):
    """From rows (node, text) to rows (node, hashes); a node that comes again at once is passed over."""

    def run(batches):
        last = None
        for batch in batches:
            for small in pieces(batch):
                rows = []
                for node, text in zip(small.column("node").to_pylist(), small.column("text"), strict=True):
                    if node != last:
                        rows.append((node, shingle_set(text.as_py() or "", width).tobytes()))
                    last = node
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["node", "hashes"])

    return run


# Components


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each component, for every node that has an edge (u, v).

    Large stars and small stars in turn, until the edges stay as they are, which
    takes a number of rounds like the logarithm of the longest way. A node's
    neighbours are never gathered: their least is an aggregate, and the join that
    spreads it is one the planner can split.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before, after = None, mark(now)
    while after[0] and after != before:
        # Least neighbours are written: both sides of a join are then dealt anew, and the planner splits a hub's.
        least = materialize(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        release(now, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u > v").distinct())
        release(large, least)
        before, after = after, mark(now)
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    found = materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    release(now)
    return found


def with_least(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """node, component_id: the smallest ``first`` that links reach from each of ``nodes`` (node, first); nulls are never smallest."""
    # Most nodes have no link and are their own component: only the others meet in an aggregate.
    roots = roots.select(F.col("node").alias("_n"), "root")
    least = nodes.join(roots, nodes.node == roots._n).groupBy("root").agg(F.min("first").alias("least"))
    ties = materialize(roots.join(least, "root").select("_n", "least"))
    return materialize(nodes.join(ties, nodes.node == ties._n, "left").select("node", F.coalesce("least", "first").alias("component_id")))


def groups(marked: DataFrame, radius: int, parts: int, identity: str = "doc_id", fp: str = "fp") -> DataFrame:
    """node, component_id: the smallest identity that links reach from each fingerprint of ``marked``; null identities are never smallest."""
    nodes = materialize(marked.groupBy(F.col(fp).alias("node")).agg(F.min(identity).alias("first")))
    return with_least(nodes, components(linked(nodes.select(F.col("node").alias("fp")), radius, parts)))


def with_components(documents: DataFrame, identity: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """identity, fingerprint (hex), component_id of every document, exactly: no link within ``radius`` is missed.

    Null and empty texts have the fingerprint zero and link like any other. Rows
    that repeat stay; no rows give no rows.
    """
    with scope() as keep:
        marked = keep(materialize(fingerprints(documents.select(F.col(identity), F.col(text)), text, width).select(identity, "fp")))
        found = keep(groups(marked, radius, radius + 1, identity=identity))
    return marked.join(found.withColumnRenamed("node", "fp"), "fp").select(identity, F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def wide_radius(likeness: float, margin: float) -> int:
    """Bits of a wide fingerprint in which sets of this Jaccard likeness differ on average, and ``margin`` (a part of all bits) for chance."""
    return int(64 * LANES * (math.acos(2 * likeness / (1 + likeness)) / math.pi + margin))


def deduplicated(documents: DataFrame, identity: str = "doc_id", text: str = "text", width: int = 5, likeness: float = 0.8, margin: float = 0.06) -> DataFrame:
    """``documents`` without near copies: of each group one text, of the smallest identity, stays (rows that repeat it wholly stay, too).

    Texts are near copies if the sets of their ``width``-word shingles have at
    least this Jaccard likeness. Candidates are texts that meet in a bucket of
    their sets' least hashes and whose wide fingerprints differ in no more bits
    than those of such texts do on average, with ``margin`` for chance;
    candidates that hang together are then compared by the sets themselves.
    None of this depends on how many documents there are. Exact copies always
    meet. Rows without identity stay only if their group has no other, one for
    each set; empty texts and those of full stops alone are one group, texts of
    other marks alone meet by what stands between white space. Columns are those
    of ``documents``, whatever their names; no rows give no rows.
    """
    with scope() as keep:
        texts = documents.select(F.col(identity).alias("_id"), F.col(text).alias("text"))
        marked = extend(texts, "text", {"fp": T.BinaryType(), "node": T.BinaryType(), "bands": T.ArrayType(T.LongType())}, set_hasher, width)
        marked = materialize(marked.select(F.col("_id").alias(identity), F.xxhash64("text").alias("copy"), "fp", "node", "bands"))
        nodes = materialize(marked.groupBy("node").agg(F.min(identity).alias("first"), F.min(F.struct(F.col(identity).alias("id"), "copy")).alias("one"), F.min("fp").alias("fp"), F.min("bands").alias("bands")))
        buckets = nodes.select(F.explode("bands").alias("key"), "fp").distinct()
        roots = components(linked_in_buckets(buckets, wide_radius(likeness, margin))).withColumnRenamed("node", "_n")
        members = materialize(nodes.join(roots, nodes.fp == roots._n, "left").select(F.coalesce("root", "fp").alias("key"), "node", F.col("one.id").alias("_one"), F.col("one.copy").alias("_copy")))
        # Only sets with a candidate are needed, one text for each. The join sorts at every size: a plan that broadcasts
        # what is asked while it is small would move no text on small inputs and all of it on large ones.
        crowds = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
        asked = materialize(members.join(crowds, "key", "left_semi"))
        met = texts.join(asked.select("node", "_one", "_copy").hint("merge"), F.col("_id").eqNullSafe(F.col("_one")) & F.xxhash64("text").eqNullSafe(F.col("_copy"))).select("node", "text")
        sets = materialize(met.mapInArrow(set_packer(width), "node binary, hashes binary"))

        def link(rows: DataFrame) -> DataFrame:
            return rows.join(sets, "node").select("key", "node", "hashes").repartition("key").sortWithinPartitions("key").mapInArrow(set_linker(likeness), "u binary, v binary")

        found = with_least(nodes.select("node", "first"), components(exhaustive(asked.select("key", "node"), link, TEXTS)))
        # All on short rows; texts meet only the rows that go, again by sorting at every size.
        rows = marked.join(found, "node").withColumn("own", F.col(identity).eqNullSafe(F.col("component_id"))).withColumn("alone", F.when(F.col("component_id").isNull(), F.col("node")))
        best = rows.where("own").groupBy(F.col("component_id").alias("_c"), F.col("alone").alias("_a")).agg(F.min("copy").alias("_best"))
        rows = rows.join(best, F.col("component_id").eqNullSafe(F.col("_c")) & F.col("alone").eqNullSafe(F.col("_a")), "left")
        own_id, own_copy = fresh(documents, "_id"), fresh(documents, "_copy")
        gone = keep(materialize(rows.where(~(F.col("own") & F.col("copy").eqNullSafe(F.col("_best")))).select(F.col(identity).alias(own_id), F.col("copy").alias(own_copy)).distinct()))
    return documents.join(gone.hint("merge"), F.col(identity).eqNullSafe(F.col(own_id)) & F.xxhash64(text).eqNullSafe(F.col(own_copy)), "left_anti")
