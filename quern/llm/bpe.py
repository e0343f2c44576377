"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The tokenizer's file gives vocabulary and merges; nothing is trained. Words are
counted over all documents, and the most frequent ones, with the ids that
merging gives them, are compiled into an automaton that shares suffixes as well
as prefixes: each transition carries how many words come before it, so that the
sum along a word's path is its number, which leads to its ids. The automaton is
one block of bytes that workers map into memory. Words it lacks are merged
exactly, by rank, with a heap: long words cost n log n.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
import tempfile
import unicodedata
from array import array
from collections import Counter
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import extend, materialize, shipped

shipped(__name__)

#: Words of the lexicon, pieces of text that a task remembers, and words that it counts before it passes them on.
LEXICON_WORDS, REMEMBERED, COUNTED = 65_536, 300_000, 400_000
#: Characters of a piece and bytes of a word above which they are neither remembered nor put into the lexicon; characters of text that a task counts before it passes words on.
LONGEST, HELD = 128, 32 << 20
#: Bytes of a word up to which it is merged in a table with others, and words of a table.
SHORT, SIDE_BY_SIDE = 48, 4096
#: Bytes at the start of a word whose way through the lexicon is remembered, and how many such ways.
HEAD, HEADS = 4, 65_536
#: Pieces of text whose ids are put together at a time.
GATHERED = 1 << 18
UNRANKED, WIDE = 1 << 60, 1 << 20
BYTES = [bytes([b]) for b in range(256)]
#: White space as the tokenizer's patterns know it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What ``str.split`` takes for white space besides.
ODD_SPACE = re.compile("[\x1c-\x1f]")


class Tokenizer:
    """Normal form, words, merges and decoding of a word-end BPE file (NFC, lower case, byte symbols, ``</w>``)."""

    def __init__(self, file: bytes):
        described = json.loads(file)
        model = described["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        pairs = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        #: Rank of a pair, whose two ids make one number; and the id that the pair of a rank becomes.
        self.rank = {a * WIDE + b: k for k, (a, b, _) in enumerate(pairs)}
        self.made = np.array([c for _, _, c in pairs])
        self.pairs, self.pair_ranks = (np.array(x) for x in zip(*sorted(self.rank.items()), strict=True))
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        symbols = byte_symbols()
        self.inner, self.last = np.array([self.ids[x] for x in symbols]), np.array([self.ids[x + self.end] for x in symbols])
        pattern = next(p["pattern"]["Regex"] for p in described["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(pattern.replace("\\s", SPACE))
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.space = re.compile(f"[{SPACE}]+")

    def chunks(self, text: str) -> list[str]:
        """The parts of a text between white space; special tokens are parts of their own."""
        if self.apart and "<|" in text and (parts := self.apart.split(text))[1:]:
            return [c for k, p in enumerate(parts) for c in ([p] if k % 2 else self.chunks(p))]
        return [c for c in self.space.split(text) if c] if ODD_SPACE.search(text) else text.split()

    def words(self, chunk: str) -> list[bytes]:
        """The words of a chunk in normal form. Letters alone, or with one common mark behind, need no pattern."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        chunk = chunk.lower()
        if chunk.isalpha():
            return [chunk.encode()]
        if chunk[-1] in ".,;:!?" and (word := chunk[:-1]).isalpha():
            return [word.encode(), chunk[-1].encode()]
        return [w.encode() for w in self.word.findall(chunk)]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: its pair of lowest rank is merged first, the leftmost of equal ones.

        Words are rows of a table, merged side by side, one pair of each at a step; long ones go by themselves.
        """
        out: list = [None] * len(words)
        rows = np.array(sorted((k for k, w in enumerate(words) if len(w) <= SHORT), key=lambda k: len(words[k])), dtype=np.int64)
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = self.merge_long(w)
        for i in range(0, len(rows), SIDE_BY_SIDE):
            part = rows[i : i + SIDE_BY_SIDE]
            for k, ids in self.merge_table(part, [words[k] for k in part]):
                out[k] = ids
        return out

    def merge_table(self, row: np.ndarray, words: list[bytes]):
        size = np.array([len(w) for w in words])
        ids = np.full((len(words), size.max() + 1), -1, np.int64)
        ids[np.arange(ids.shape[1]) < size[:, None]] = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ids[np.arange(len(words)), size - 1] = self.last[[w[-1] for w in words]]
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        while len(row):
            best = rank.argmin(axis=1)
            at = np.arange(len(row))
            lowest = rank[at, best]
            done = lowest == UNRANKED
            if done.any():
                for k, r in zip(row[done].tolist(), ids[done].tolist(), strict=True):
                    yield k, r[: r.index(-1)]
                row, ids, rank, best, lowest = row[~done], ids[~done], rank[~done], best[~done], lowest[~done]
                at = np.arange(len(row))
            new = self.made[lowest]
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > best[:, None]), 1)
            ids[at, best] = new
            column = column[:-1]
            rank = np.take_along_axis(rank, column + (column >= best[:, None]), 1)
            if not rank.shape[1]:  # words of one symbol are left
                rank = np.full((len(row), 1), UNRANKED)
                ids = np.concatenate([ids, np.full((len(row), 1), -1)], axis=1)
                continue
            right = best < rank.shape[1]
            rank[at[right], best[right]] = self.ranks(new[right], ids[at[right], best[right] + 1])
            left = best > 0
            rank[at[left], best[left] - 1] = self.ranks(ids[at[left], best[left] - 1], new[left])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; what is no pair has UNRANKED."""
        pair = a * WIDE + b
        k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[k] == pair) & (a >= 0) & (b >= 0), self.pair_ranks[k], UNRANKED)

    def merge_long(self, word: bytes) -> list[int]:
        """The same for one word with a heap of pairs, each one number (rank, place); a pair that has changed since is passed over."""
        symbols = self.inner[np.frombuffer(word, np.uint8)]
        symbols[-1] = self.last[word[-1]]
        n = len(symbols)
        rank = self.ranks(symbols[:-1], symbols[1:])
        at = np.nonzero(rank != UNRANKED)[0]
        heap = np.sort(rank[at] << 32 | at).tolist()  # sorted numbers are a heap
        ids, after, before = array("i", symbols.tolist()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        after[-1] = -1
        get, made = self.rank.get, self.made.tolist()
        while heap:
            lowest = heapq.heappop(heap)
            i = lowest & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] * WIDE + ids[j]) != lowest >> 32:
                continue
            ids[i], ids[j] = made[lowest >> 32], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(ids[i] * WIDE + ids[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := get(ids[h] * WIDE + ids[i])) is not None:
                heapq.heappush(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def decode(self, ids) -> str:
        """Tokens joined by one space, as a tokenizer file without a decoder has it."""
        return " ".join([self.tokens[i] for i in ids])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal automaton of the words, with their ids, as one block of bytes.

    Words come in order. Once a word leaves the path of the one before it, the
    states behind the parting point are final in shape: each is replaced by an
    equal one that exists, or kept.
    """
    words = sorted(entries)
    known: dict[tuple, int] = {}
    made: list[tuple[bool, tuple]] = []  # of kept states: accepts, ((label, state), ...)
    path: list[list] = [[False, []]]  # of the last word: accepts, [[label, state], ...]

    def keep(state: list) -> int:
        key = (state[0], tuple(map(tuple, state[1])))
        if key not in known:
            known[key] = len(made)
            made.append(key)
        return known[key]

    last = b""
    for word in [*words, None]:
        common = 0 if word is None else next((k for k, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        while len(path) > common + 1:
            done = keep(path.pop())
            path[-1][1][-1][1] = done
        if word is not None:
            for label in word[common:]:
                path[-1][1].append([label, -1])
                path.append([False, []])
            path[-1][0] = True
            last = word
    start = keep(path[0])
    below = []  # words from each state on: states come after those they lead to
    for accepts, edges in made:
        below.append(accepts + sum(below[s] for _, s in edges))
    labels, targets, skips, first = bytearray(), [], [], [0]
    for accepts, edges in made:
        passed = int(accepts)
        for label, s in edges:
            labels.append(label)
            targets.append(s)
            skips.append(passed)
            passed += below[s]
        first.append(len(labels))
    offsets = [0, *accumulate(len(entries[w]) for w in words)]
    parts = [np.array(x, dtype="<i4").tobytes() for x in (first, targets, skips, [accepts for accepts, _ in made], offsets, list(chain.from_iterable(entries[w] for w in words)))]
    head = struct.pack("<8i", start, *map(len, parts), len(labels))
    return head + b"".join(parts) + bytes(labels)


class Lexicon:
    """Look-up in a compiled lexicon, mapped into memory from a file without a name."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(block)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self.start, *sizes, n = struct.unpack_from("<8i", self.map)
        at, arrays = 32, []
        for size in sizes:
            arrays.append(memoryview(self.map)[at : at + size].cast("i"))
            at += size
        self.first, self.targets, self.skips, self.accepts, self.offsets, self.ids = arrays
        self.labels = at
        #: Where the first bytes of words lead.
        self.heads: dict[bytes, tuple[int, int]] = {}

    def find(self, word: bytes) -> list[int] | None:
        head = word[:HEAD]
        if (at := self.heads.get(head)) is None:
            at = self.walk(self.start, 0, head)
            if len(self.heads) < HEADS:
                self.heads[head] = at
        state, number = self.walk(*at, word[HEAD:]) if len(word) > HEAD and at[0] >= 0 else at
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist() if state >= 0 and self.accepts[state] else None

    def walk(self, state: int, number: int, word: bytes) -> tuple[int, int]:
        """The state behind ``word`` and how many words come before; no way: state -1."""
        first, labels, seek, skips, targets = self.first, self.labels, self.map.find, self.skips, self.targets
        for label in word:
            k = seek(BYTES[label], labels + first[state], labels + first[state + 1])
            if k < 0:
                return -1, 0
            k -= labels
            number += skips[k]
            state = targets[k]
        return state, number


def count_words(documents: DataFrame, file, text: str = "text") -> DataFrame:
    """word (binary), n: how often each word of up to ``LONGEST`` bytes occurs in all texts; each task sums what it has seen first."""

    def run(batches):
        tokenizer = Tokenizer(file.value)

        def summed(seen: Counter):
            words: Counter = Counter()
            for chunk, n in seen.items():
                if chunk not in tokenizer.special:
                    for w in tokenizer.words(chunk):
                        if len(w) <= LONGEST:
                            words[w] += n
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        held = 0
        for batch in batches:
            for value in batch.column(0):
                if (t := value.as_py()):
                    seen.update(tokenizer.chunks(t))
                    held += len(t)
                    if len(seen) > COUNTED or held > HELD:
                        yield summed(seen)
                        seen.clear()
                        held = 0
        if seen:
            yield summed(seen)

    return documents.select(F.col(f"`{text}`")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(documents: DataFrame, file, text: str = "text", most: int = LEXICON_WORDS) -> list[bytes]:
    """At most ``most`` words, the most frequent ones of all texts, in byte order.

    A histogram of the counts, in finely graded bins, says how frequent a word
    must be; a bin that would not fit whole is left out. So the driver receives
    a histogram of bounded length and the words themselves, and nothing by task.
    """
    counts = materialize(count_words(documents, file, text).where("n > 1"))
    level = F.floor(F.log2("n") * 64).cast("int")
    least, held = None, 0
    for b, n in sorted(counts.groupBy(level.alias("b")).count().collect(), reverse=True):
        if (held := held + n) > most:
            break
        least = b
    if least is None:
        return []
    return sorted(bytes(r[0]) for r in counts.where(level >= least).select("word").collect())


def encoder(file, block):
    tokenizer, lexicon = Tokenizer(file.value), Lexicon(block.value)
    tokens = pa.array([tokenizer.tokens.get(k, "") for k in range(max(tokenizer.tokens) + 1)], pa.string())
    # Chunks in two generations: what the younger finds in the older one stays when the older one goes.
    # Each has its chunks' numbers, the ids of all its chunks in one array, and where a chunk's ids begin.
    # Words below them: a chunk that is new in its capitals or marks is often no new word.
    young: dict[str, int] = {}
    old: dict[str, int] = {}
    ids, begins, old_ids, old_begins = array("i"), array("q", [0]), array("i"), array("q", [0])
    known: dict[bytes, list[int]] = {}
    large: list[bytes] = []  # in ``known`` for one batch only

    def learn(chunks: list[str]) -> None:
        """Ids of chunks that the younger generation lacks, in its arrays: from the lexicon, or else merged."""
        fresh, rest = [], []
        for c in chunks:
            (rest if c in old or c in tokenizer.special else fresh).append(c)
        split = list(map(tokenizer.words, fresh))
        unseen = []
        for w in set(chain.from_iterable(split)) - known.keys():
            if (found := lexicon.find(w)) is None:
                unseen.append(w)
            else:
                known[w] = found
        known.update(zip(unseen, tokenizer.merge(unseen), strict=True))
        large.extend(w for w in unseen if len(w) > LONGEST)
        made, marks, before = [], [], len(ids)
        for ws in split:
            for w in ws:
                made += known[w]
            marks.append(before + len(made))
        for c in rest:
            made += [tokenizer.special[c]] if (k := old.get(c)) is None else old_ids[old_begins[k] : old_begins[k + 1]]
            marks.append(before + len(made))
        ids.extend(array("i", made))
        begins.extend(array("q", marks))
        young.update(zip(chain(fresh, rest), range(len(young), len(young) + len(chunks))))

    def compute(texts: list[str]) -> list:
        nonlocal young, old, ids, begins, old_ids, old_begins
        if len(young) > REMEMBERED:
            young, old, ids, begins, old_ids, old_begins = {}, young, array("i"), array("q", [0]), ids, begins
        if len(known) > 2 * REMEMBERED:
            known.clear()
        chunks = [tokenizer.chunks(t) for t in texts]
        until = np.cumsum([0, *map(len, chunks)])
        every = list(chain.from_iterable(chunks))
        del chunks
        number = np.fromiter(map(young.get, every, repeat(-1)), np.int32, len(every))
        lacking = np.nonzero(number < 0)[0]
        missed = [every[k] for k in lacking.tolist()]
        new = set(missed)
        long = [c for c in new if len(c) > LONGEST]
        learn(list(new.difference(long)) if long else list(new))
        kept = len(begins)
        learn(long)
        number[lacking] = [young[c] for c in missed]
        store, begin = np.array(ids), np.array(begins)
        size = begin[number + 1] - begin[number]
        parts = [np.empty(0, np.int32)]
        for k in range(0, len(number), GATHERED):
            n = size[k : k + GATHERED]
            ends = np.cumsum(n)
            parts.append(store[np.repeat(begin[number[k : k + GATHERED]] - (ends - n), n) + np.arange(ends[-1])])
        offsets = np.concatenate([[0], np.cumsum(size)])[until].astype(np.int32)
        coded = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
        for c in long:
            del young[c]
        del begins[kept:], ids[begins[kept - 1] :]
        for w in large:
            known.pop(w, None)
        large.clear()
        # Tokens joined by one space, as ``Tokenizer.decode`` has it.
        return [coded, pc.binary_join(pa.ListArray.from_arrays(coded.offsets, tokens.take(coded.values)), " ")]

    return compute


def encode(documents: DataFrame, path: str, text: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """``documents`` with ``ids`` (array of int) and ``decoded`` (string), read from the tokenizer file at ``path``.

    Null and empty texts give no ids and an empty string. Strings of special
    tokens in a text are those tokens. Repeated rows stay; columns named ``ids``
    or ``decoded`` are replaced; no rows give no rows.
    """
    context = documents.sparkSession.sparkContext
    with open(path, "rb") as f:
        raw = f.read()
    file = context.broadcast(raw)  # as large as the tokenizer's file
    tokenizer = Tokenizer(raw)
    frequent = frequent_words(documents, file, text, words)
    block = context.broadcast(compile_lexicon(dict(zip(frequent, tokenizer.merge(frequent), strict=True))))  # bounded by ``words``
    return extend(documents, text, {"ids": T.ArrayType(T.IntegerType(), False), "decoded": T.StringType()}, encoder, file, block)
