"""Spelling variants: words at one edit, found with search schemes over bidirectional FM-indexes of the vocabulary.

Words at one edit share one half exactly. The vocabulary is therefore cut twice into shards of neighbouring words, once in its order and once in
the order of the reversed words. A word asks the shards that can hold words beginning with its first half, and those that can hold words
ending in its second. A shard is one text, ``|word|word|...|``, under an index of that text and of its reverse: a pattern's suffix-rank interval
can grow to either side. The exact half is matched first, with the delimiter at its outer end; then the interval grows across the other half with one
error, up to the delimiter. An insertion is a deletion seen from the longer word, and of two words of one length the smaller one asks, so every
pair is found once: a deletion within a run of equal letters counts as that of its last letter.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_key, slices, small_batches, stored, texts_of
from .tables import ChunkTable

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One occurrence in so many loses a letter.
LOSS = 97
#: About so many words a shard; its bounds are every ``EACH``-th of the words that a hash draws, cut to ``BOUND`` code points.
SHARD, EACH, BOUND = 8192, 8, 64
#: Patterns that are searched at a time, and places between two counts of an index.
PATTERNS, STRIDE = 4096, 32
_RUNS = re.compile("[a-zÀ-ÿ]+")
#: Bytes of a run up to which its checksum follows from a table.
TABLED = 64
_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)


class Runs(ChunkTable):
    """Distinct runs with their checksums alone, their lengths and how often each was seen."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.names: list[str] = []
        self.crc, self.size, self.n = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def fill(self, new: list) -> None:
        coded = [w.encode() for w in new]
        self.names += new
        self.crc = np.concatenate([self.crc, np.fromiter((zlib.crc32(b) for b in coded), np.uint32, len(new))])
        self.size = np.concatenate([self.size, np.fromiter(map(len, coded), np.int64, len(new))])
        self.n = np.concatenate([self.n, np.zeros(len(new), np.int64)])


def checksums(prefixes: list[bytes]) -> np.ndarray:
    """For each prefix and number of bytes: what to combine with the checksum of so many bytes alone to get that of both together."""
    out = np.empty((len(prefixes), TABLED + 1), np.uint32)
    out[:, 0] = [zlib.crc32(p) for p in prefixes]
    for k in range(1, TABLED + 1):  # a checksum is linear: a zero byte more moves it on
        out[:, k] = (out[:, k - 1] >> np.uint32(8)) ^ _CRC[out[:, k - 1] & np.uint32(255)]
    return out


def _count(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    table, lost = Runs(), {}

    def rows():
        counts = dict(lost)
        for w, n in zip(table.names, table.n.tolist(), strict=True):
            if n and len(w) >= least:
                counts[w] = counts.get(w, 0) + n
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in slices(batches):
        if len(table.codes) > table.limit:
            yield rows()
            table.clear()
            lost = {}
        prefixes = [f"{'' if i is None else i}:".encode() for i in batch.column(0).to_pylist()]
        codes, counts = table.look_up([_RUNS.findall(t.encode().lower().decode()) for t in texts_of(batch)])
        doc, size = np.repeat(np.arange(len(prefixes)), counts), table.size[codes]
        h = checksums(prefixes)[doc, np.minimum(size, TABLED)] ^ table.crc[codes]
        for at in np.nonzero(size > TABLED)[0].tolist():
            h[at] = zlib.crc32(table.names[codes[at]].encode(), zlib.crc32(prefixes[doc[at]]))
        hit = h % LOSS == 0
        table.n += np.bincount(codes[~hit], minlength=len(table.n))
        for c, k in zip(codes[hit].tolist(), h[hit].tolist(), strict=True):
            w = table.names[c]
            k %= len(w)
            w = w[:k] + w[k + 1 :]
            if len(w) >= least:
                lost[w] = lost.get(w, 0) + 1
    yield rows()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of at least ``length`` code points and ``count`` occurrences."""
    rows = docs.select(docs[doc_id].cast("string").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _count(it, length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by ranks of prefixes that double in length; the last symbol occurs nowhere else and is the least."""
    rank, width = text.astype(np.int64), 1
    while True:
        after = np.zeros_like(rank)
        after[: len(rank) - width] = rank[width:] + 1
        key = rank * (len(rank) + int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank[order] = new
        if new[-1] == len(rank) - 1:
            return order
        width = min(2 * width, len(rank) - 1)


class Ranks:
    """How often a symbol, and how often a smaller one, stands before a place of a transformed text."""

    def __init__(self, bwt: np.ndarray, symbols: int):
        n = len(bwt)
        self.blocks = np.full((n // STRIDE + 1, STRIDE), symbols, bwt.dtype)  # filled up with a symbol that nobody asks for
        self.blocks.ravel()[:n] = bwt
        here = np.zeros((len(self.blocks) + 1, symbols + 1), np.int32)
        np.add.at(here, (np.arange(n) // STRIDE + 1, bwt), 1)
        self.same = np.cumsum(here, 0, dtype=np.int32)
        self.less = np.cumsum(self.same, 1, dtype=np.int32) - self.same

    def __call__(self, c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block, seen = self.blocks[at // STRIDE], np.arange(STRIDE) < (at % STRIDE)[:, None]
        same = self.same[at // STRIDE, c] + ((block == c[:, None]) & seen).sum(1)
        return same, self.less[at // STRIDE, c] + ((block < c[:, None]) & seen).sum(1)


class Index:
    """A bidirectional FM-index of delimited words. An interval is (first rank, first rank in the reverse, size)."""

    END, BAR = 0, 1

    def __init__(self, words: list[str]):
        points = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points[points > 0])
        symbols = len(self.alphabet) + 2
        kind = np.uint8 if symbols < 255 else np.uint32
        text = np.where(points > 0, np.searchsorted(self.alphabet, points) + 2, self.BAR)
        self.symbols, self.n = symbols, len(text) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(np.append(text, self.END), minlength=symbols))])
        self.sides = []
        for t in (np.append(text, self.END), np.append(text[::-1], self.END)):
            order = suffix_array(t)
            if not self.sides:
                self.word_at = (np.cumsum(t == self.BAR) - 1)[order]  # of the delimiter in front of a word
            self.sides.append(Ranks(t[order - 1].astype(kind), symbols))

    def coded(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of code points (the number of symbols where one does not occur), and the first greater symbol of each."""
        at = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points
        return np.where(known, at + 2, self.symbols), np.where(known, at + 3, at + 2)

    def grow(self, where: list[np.ndarray], c: np.ndarray, right: bool) -> list[np.ndarray]:
        """Intervals with one symbol more on one side; an unknown symbol leaves nothing."""
        a, b, size = where if not right else (where[1], where[0], where[2])
        known = c < self.symbols
        s = np.where(known, c, 0)
        ranks = self.sides[right]
        (low, under), (high, over) = ranks(s, a), ranks(s, a + size)
        a, b, size = self.first[s] + low, b + over - under, np.where(known, high - low, 0)
        return [a, b, size] if not right else [b, a, size]


def search(index: Index, words: list[str], head: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number of a pattern, number of an indexed word): one deletion, or one greater symbol, in the pattern's second half (``head``) or first."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    start = np.cumsum(lens) - lens
    symbol, greater = index.coded(points)
    ends_run = np.append(points[1:] != points[:-1], True)
    ends_run[start + lens - 1] = True
    half = lens // 2
    exact, rest = (half, lens - half) if head else (lens - half, half)
    q = np.arange(len(words))
    state = [np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), index.n, np.int64)]
    # the exact half, from the cut outwards, and the delimiter
    for k in range(int(exact.max()) + 1):
        inside = exact[q] > k
        last = exact[q] == k
        at = start[q] + np.where(head, half[q] - 1 - k, half[q] + k)
        c = np.where(inside, symbol[np.where(inside, at, 0)], index.BAR)
        grown = index.grow(state, c, not head)
        state = [np.where(inside | last, g, s) for g, s in zip(grown, state, strict=True)]
        alive = state[2] > 0
        q, state = q[alive], [s[alive] for s in state]
    # the other half, with one error
    step, wrong = np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    pairs = []
    while len(q):
        over = step == rest[q]
        if over.any():
            full = over & wrong
            got = index.grow([s[full] for s in state], np.full(int(full.sum()), index.BAR), head)
            found = got[2] > 0
            pairs.append((q[full][found], index.word_at[got[0][found]]))
            q, step, wrong, state = q[~over], step[~over], wrong[~over], [s[~over] for s in state]
        at = start[q] + np.where(head, half[q] + step, half[q] - 1 - step)
        right = np.nonzero(~wrong)[0]
        gone = right[ends_run[at[right]]]
        many = index.symbols - greater[at[right]]
        other = np.repeat(right, many)
        c = greater[at[other]] + np.arange(len(other)) - np.repeat(np.cumsum(many) - many, many)
        who = np.concatenate([np.arange(len(q)), other])
        grown = index.grow([s[who] for s in state], np.concatenate([symbol[at], c]), head)
        bad = np.concatenate([wrong, np.ones(len(other), bool)])
        alive = grown[2] > 0
        who, bad = who[alive], bad[alive]
        state = [np.concatenate([g[alive], s[gone]]) for g, s in zip(grown, state, strict=True)]
        step = np.concatenate([step[who], step[gone]]) + 1
        wrong = np.concatenate([bad, np.ones(len(gone), bool)])
        q = np.concatenate([q[who], q[gone]])
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def _posted(batches, bounds: dict[bool, list[str]]):
    """``head, shard, asks, word, n``: every word in its shard of either order, and its question to the shards that can hold its half."""
    for batch in batches:
        out = [[], [], [], [], []]
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            half = len(word) // 2
            for head, own, part in ((True, word, word[:half]), (False, word[::-1], word[half:][::-1])):
                mine = bisect_right(bounds[head], own)
                asked = range(bisect_right(bounds[head], part), bisect_left(bounds[head], part + "\U0010ffff") + 1)
                for shard, asks in ((mine, False), *((s, True) for s in asked)):
                    for column, x in zip(out, (head, shard, asks, word, n), strict=True):
                        column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.bool_()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.string()), pa.array(out[4], pa.int64())], names=["head", "shard", "asks", "word", "n"])


_PAIR = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _searched(table: pa.Table) -> pa.Table:
    head, asks = table.column("head")[0].as_py(), table.column("asks").to_numpy()
    word, n = np.array(table.column("word").to_pylist(), object), table.column("n").to_numpy()
    mine, my_n, theirs, their_n = word[~asks], n[~asks], word[asks], n[asks]
    if not len(mine) or not len(theirs):
        return _PAIR.empty_table()
    index, parts = Index(mine.tolist()), []
    for k in range(0, len(theirs), PATTERNS):
        a, b = search(index, theirs[k : k + PATTERNS].tolist(), head)
        parts.append((a + k, b))
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    both = [np.concatenate([theirs[a], mine[b]]), np.concatenate([mine[b], theirs[a]]), np.concatenate([my_n[b], their_n[a]])]
    return pa.table([pa.array(both[0], pa.string()), pa.array(both[1], pa.string()), pa.array(both[2], pa.int64())], schema=_PAIR)


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: both directions of every pair of ``word, n`` (distinct words of at least two code points) at exactly one edit."""
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(SHARD // EACH)) == 0).select(F.substring("word", 1, BOUND).alias("head"), F.substring(F.reverse("word"), 1, BOUND).alias("tail")).toArrow()
    bounds = {}
    for head, name in ((True, "head"), (False, "tail")):
        found = sorted(set(drawn.column(name).to_pylist()))
        bounds[head] = found[EACH - 1 :: EACH]
    shared = words.sparkSession.sparkContext.broadcast(bounds)
    posted = words.select("word", "n").mapInArrow(lambda it: _posted(it, shared.value), "head boolean, shard int, asks boolean, word string, n long")
    return posted.groupBy("head", "shard").applyInArrow(_searched, "word string, near string, near_n long")


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the last of the chain of forms, by following twice as many at a time."""
    now, total = stored(forms.select("word", F.col("form").alias("root"))), forms.count()
    while True:
        ends = now.groupBy("root").agg(F.count("*").alias("n")).join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        ends = stored(ends)
        if not ends.where("next is not null").limit(1).count():
            return now
        now = stored(joined_by_key(now, ends, "root", total).select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    A word's form is the most frequent of the words at one edit (of ties the first by code points) if it is at least twice as frequent; its root is where
    the chain of forms ends, itself without a form. Null and empty texts have no words; very long texts and words are read whole. A null
    id counts as an empty one. Repeated rows count each time; other columns are not carried, so their names cannot clash. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    words = stored(vocabulary(docs, doc_id, text))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    good = F.col("form_n") >= 2 * F.col("n")
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    roots = roots_of(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
