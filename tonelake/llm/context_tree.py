"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a tree of contexts, the up to ``DEPTH`` bytes before it. A node holds how
often a 0 and a 1 followed, and their Krichevsky-Trofimov estimate. A node's weighted probability is the mean of its own and of the
product of its children's; so all depths are mixed, each with the weight that the training text gives it. The tree is fitted on
counts gathered from every training text and then stands fixed. A text's score is the log10 probability of its bytes (A-Z in
lower case) and of an end symbol.

All counted nodes are kept. The counts are a stored table of the distinct grams (a context and the byte after it). The nodes of
depth ``CUT`` and deeper hang together only below one context of ``CUT`` bytes, a branch; tasks take whole branches, weight them from the
bottom up and give sums for each node above. Only those above are collected: their number is bounded by the byte values, not by
the corpus. With them, tasks go through the branches again and give the probability of every gram that is asked for. Frequent grams (at
least 1 / ``GRAM_SHARES`` of all training bytes, so at most that many) are broadcast with their probabilities; all others are counted
in each text and joined by shuffle. Word counts for the base are whole too: the frequent words (at least 1 / ``WORD_SHARES`` of all
tokens) are broadcast, all others are counted in each text and joined by shuffle. A gram or word that is rare in training and yet stands in
a large share of the texts is joined by broadcast as well. Words are counted by a 64-bit hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_key, slices, small_batches, stored
from .shingles import LOWER, flat_bytes, word_hashes

DEPTH = 5
CUT = 3
GRAM_SHARES = 1 << 21
WORD_SHARES = 1 << 20
END = 0xFF  # in no UTF-8 text
_KEY_AT = np.uint64(48)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and the end after it: the ``DEPTH`` bytes before and itself, as one number; and how many each text has."""
    data, offsets = flat_bytes(column)
    size = np.diff(offsets)
    n = len(size)
    # DEPTH end symbols before each text; the first of them closes the text before
    room = np.full(len(data) + DEPTH * (n + 1), END, np.uint8)
    room[np.arange(len(data)) + DEPTH * (np.repeat(np.arange(n), size) + 1)] = LOWER[data]
    out = np.zeros(len(room) - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        out = (out << np.uint64(8)) | room[k : len(out) + k]
    keep = np.ones(len(out), bool)
    gaps = (offsets[1:] + DEPTH * np.arange(n))[:, None] + np.arange(1, DEPTH)
    keep[gaps.ravel()[gaps.ravel() < len(out)]] = False
    return out[keep], size + 1


class _Sums:
    """Counts by key, merged when they grow."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > 3_000_000:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([c for _, c in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(batches):
    sums, docs = {0: _Sums(), 1: _Sums()}, 0
    for batch in slices(batches):
        column = batch.column(0)
        docs += len(column)
        sums[0].add(word_hashes(*flat_bytes(column))[0])
        sums[1].add(grams(column)[0])
        for kind, s in sums.items():
            if s.size > 2_500_000:
                yield from _emit(kind, *s.total())
                sums[kind] = _Sums()
    for kind, s in sums.items():
        yield from _emit(kind, *s.total())
    yield from _emit(2, np.zeros(1, np.uint64), np.array([docs], np.int64))


def _emit(kind: int, keys: np.ndarray, counts: np.ndarray):
    for i in range(0, len(keys), 200_000):
        k = keys[i : i + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(counts[i : i + 200_000].astype(np.int64))], names=["kind", "key", "n"])


def _context(gram: np.ndarray, depth: int) -> np.ndarray:
    return (gram >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at ``x`` + 8, carried back by the recurrence."""
    y, product = x + 8, x.copy()
    for k in range(1, 8):
        product *= x + k
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log-probability that the estimator gives to ``a`` zeros and ``b`` ones in any one order."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)


class Tree:
    """Nodes in order of their keys, and the mixed probability of a 1 where each is the deepest on the path.

    ``below``: for the nodes of depth ``CUT`` - 1, the sums of their children's weighted log-probabilities, where the children are elsewhere.
    """

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None = None):
        roots = np.arange(1, 256, dtype=np.uint64)
        missing = np.setdiff1d(roots, keys)
        keys = np.concatenate([keys, missing])
        a, b = np.concatenate([zeros, np.zeros(len(missing))]).astype(float), np.concatenate([ones, np.zeros(len(missing))]).astype(float)
        order = np.argsort(keys)
        keys, a, b = keys[order], a[order], b[order]
        depth = (keys >> _KEY_AT).astype(np.int64)
        own, one = _log_kt(a, b), (b + 0.5) / (a + b + 1)
        cut = (depth == CUT - 1) & (below is not None)
        below = np.zeros(len(keys)) if below is None else np.concatenate([below, np.zeros(len(missing))])[order]
        weighted, kid_a, kid_b, parent = own.copy(), np.where(cut, a, 0.0), np.where(cut, b, 0.0), np.zeros(len(keys), np.int64)
        has = cut.copy()
        half = math.log(0.5)
        weight = np.ones(len(keys))
        rest_one = one.copy()

        def close(at: np.ndarray) -> None:
            at = at[has[at]]
            rest_a, rest_b = a[at] - kid_a[at], b[at] - kid_b[at]
            rest_one[at] = (rest_b + 0.5) / (rest_a + rest_b + 1)
            weighted[at] = np.logaddexp(half + own[at], half + below[at] + _log_kt(rest_a, rest_b))
            weight[at] = np.exp(half + own[at] - weighted[at])

        for d in range(DEPTH, 0, -1):
            at = np.flatnonzero(depth == d)
            close(at)
            ctx, prefix = (keys[at] >> np.uint64(8)) & np.uint64((1 << 40) - 1), keys[at] & np.uint64(255)
            up = (np.uint64(d - 1) << _KEY_AT) | ((ctx & np.uint64((1 << 8 * (d - 1)) - 1)) << np.uint64(8)) | prefix
            parent[at] = np.searchsorted(keys, up)
            for total, part in ((below, weighted), (kid_a, a), (kid_b, b)):
                np.add.at(total, parent[at], part[at])
            has[parent[at]] = True
        close(np.flatnonzero(depth == 0))
        done, left = np.zeros(len(keys)), np.ones(len(keys))
        for d in range(1, DEPTH + 1):
            at = np.flatnonzero(depth == d)
            p = parent[at]
            done[at] = done[p] + left[p] * weight[p] * one[p]
            left[at] = left[p] * (1 - weight[p])
        self.keys, self.one = keys, (done + left * (weight * one + (1 - weight) * rest_one))
        self.done, self.left = done + left * weight * one, left * (1 - weight)

    def handed(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What nodes of depth ``CUT`` - 1 hand to their children: probability of a 1 so far, and the weight left. Without such a node the deepest above it gives all."""
        done, left, todo = np.empty(len(keys)), np.zeros(len(keys)), np.arange(len(keys))
        for d in range(CUT - 1, -1, -1):
            key = (np.uint64(d) << _KEY_AT) | _up(keys[todo], d)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            if d == CUT - 1:
                done[todo[hit]], left[todo[hit]] = self.done[at[hit]], self.left[at[hit]]
            else:
                done[todo[hit]] = self.one[at[hit]]
            todo = todo[~hit]
        return done, left


def _up(keys: np.ndarray, depth: int) -> np.ndarray:
    """Of a node's context and bit prefix, the node above it at ``depth``."""
    return keys & np.uint64((1 << 8 * (depth + 1)) - 1)


def _branches(batches, least: int = 200_000):
    """Rows in order of their branches -> distinct grams in order, their counts, and how often they are asked for; whole branches, some at a time."""
    held, size, next_cut = [], 0, least

    def joined():
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    def merged(gram, n, wanted):
        order = np.argsort(gram)
        gram, n, wanted = gram[order], n[order], wanted[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        return gram[first], np.add.reduceat(n, first), np.add.reduceat(wanted, first)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy()))
        size += batch.num_rows
        if size >= next_cut:
            rows = joined()
            branch = _context(rows[0], CUT)
            cut = int(np.searchsorted(branch, branch[-1]))
            if cut:
                yield merged(*(x[:cut] for x in rows))
            held, size = [tuple(x[cut:].copy() for x in rows)], size - cut
            next_cut = max(least, 2 * size)
    if size:
        yield merged(*joined())


def _weighted(gram: np.ndarray, n: np.ndarray):
    """For each of the 8 decisions: which grams have a 1, and the levels from ``DEPTH`` to ``CUT``: node keys, the place of each row below among them, zeros, ones, own weight, log-probability.

    A gram with count 0 adds nothing to any node, so it can be asked for along with the counted ones.
    """
    byte, half = gram & np.uint64(255), math.log(0.5)
    for j in range(8):
        one = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        keys = (_context(gram, DEPTH) << np.uint64(8)) | np.uint64(1 << j) | (byte >> np.uint64(8 - j))
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        place, keys = np.cumsum(new) - 1, keys[new]
        a, b = np.bincount(place, np.where(one, 0, n)), np.bincount(place, np.where(one, n, 0))
        logs = _log_kt(a, b)
        levels = [(keys, place, a, b, np.ones(len(keys)), logs)]
        for d in range(DEPTH - 1, CUT - 1, -1):
            keys, place = np.unique(_up(keys, d), return_inverse=True)
            a, b, below = np.bincount(place, a), np.bincount(place, b), np.bincount(place, logs)
            own = half + _log_kt(a, b)
            logs = np.logaddexp(own, half + below)
            levels.append((keys, place, a, b, np.exp(own - logs), logs))
        yield one, levels


def _sums_above(batches):
    """For the nodes of depth ``CUT`` - 1: counts, and the sum of their children's weighted log-probabilities."""
    for gram, n, _ in _branches(batches):
        for _, levels in _weighted(gram, n):
            keys, _, a, b, _, logs = levels[-1]
            above, place = np.unique(_up(keys, CUT - 1), return_inverse=True)
            columns = [above.view(np.int64), *(np.bincount(place, x) for x in (a, b, logs))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "zeros", "ones", "below"])


def _gram_scores(batches, shared):
    """log10 probabilities of the grams that are asked for, and how often they are; branches without one are left out."""
    top = shared.value
    for gram, n, wanted in _branches(batches):
        branch = _context(gram, CUT)
        some = np.isin(branch, np.unique(branch[wanted > 0]))
        gram, n, wanted = gram[some], n[some], wanted[some]
        if not len(gram):
            continue
        out = np.zeros(len(gram))
        for one, levels in _weighted(gram, n):
            done, left = top.handed(_up(levels[-1][0], CUT - 1))
            for k in range(len(levels) - 1, -1, -1):
                _, place, a, b, weight, _ = levels[k]
                done, left = (done + left * weight * (b + 0.5) / (a + b + 1))[place], (left * (1 - weight))[place]
            out += np.log10(np.where(one, done, 1 - done))
        asked = wanted > 0
        yield pa.RecordBatch.from_arrays([pa.array(gram[asked].view(np.int64)), pa.array(out[asked]), pa.array(wanted[asked])], names=["gram", "log10", "n"])


class Model:
    """All counted nodes: the stored table of grams, and the tree above the branches."""

    def __init__(self, grams: DataFrame):
        self.grams = grams
        rows = self._by_branch(grams.select("gram", "n", F.lit(0).cast("long").alias("wanted"))).mapInArrow(_sums_above, "key long, zeros double, ones double, below double")
        got = rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow().to_pandas()
        key, values = got["key"].to_numpy(np.int64).view(np.uint64), [got[c].to_numpy(float) for c in ("zeros", "ones", "below")]
        keys, sums = [], []
        for d in range(CUT - 1, -1, -1):
            nodes, place = np.unique(_up(key, d), return_inverse=True)
            keys.append((np.uint64(d) << _KEY_AT) | nodes)
            sums.append([np.bincount(place, x, len(nodes)) if d == CUT - 1 or k < 2 else np.zeros(len(nodes)) for k, x in enumerate(values)])
        self.top = Tree(np.concatenate(keys), *(np.concatenate(x) for x in zip(*sums, strict=True)))
        self.shared = grams.sparkSession.sparkContext.broadcast(self.top)

    @staticmethod
    def _by_branch(rows: DataFrame) -> DataFrame:
        branch = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * CUT) - 1))
        return rows.repartition(branch).sortWithinPartitions(branch)

    def scores(self, wanted: DataFrame) -> DataFrame:
        """``gram``, ``log10`` and ``n`` (its rows) of the distinct values of ``gram`` in ``wanted``."""
        asked = wanted.groupBy("gram").agg(F.count("*").alias("wanted"))
        rows = self.grams.select("gram", "n", F.lit(0).cast("long").alias("wanted")).unionByName(asked.select("gram", F.lit(0).cast("long").alias("n"), "wanted"))
        return self._scored(rows)

    def frequent(self, least: int) -> DataFrame:
        """``gram`` and ``log10`` of the grams counted at least ``least`` times."""
        return self._scored(self.grams.select("gram", "n", (F.col("n") >= least).cast("long").alias("wanted")))

    def _scored(self, rows: DataFrame) -> DataFrame:
        shared = self.shared
        return self._by_branch(rows).mapInArrow(lambda it: _gram_scores(it, shared), "gram long, log10 double, n long")

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the bytes before it, for few grams."""
        wanted = self.grams.sparkSession.createDataFrame([(int(g),) for g in gram], "gram long")
        found = {r["gram"]: r["log10"] for r in self.scores(wanted).collect()}
        return np.array([found[int(g)] for g in gram])


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words array<long>, word_counts array<long>, grams array<long>, gram_counts array<long>"


def _counted(keys: np.ndarray, owner: np.ndarray, n: int) -> list[pa.ListArray]:
    """For each of ``n`` owners its distinct keys, and how often it has each."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else np.empty(0, np.int64)
    times = np.diff(np.concatenate([first, [len(keys)]])) if len(keys) else first
    at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=n))]).astype(np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(x)) for x in (keys[first].view(np.int64), times.astype(np.int64))]


def _score(batches, shared):
    often, logs, words, counts, total, distinct, ends = shared.value
    rid = TaskContext.get().partitionId() << 33
    scale = math.log10(total + 0.5 * (distinct + 1))
    value = np.log10(counts + 0.5) - scale
    for batch in slices(batches):
        column = batch.column(2)
        n = len(column)
        hashes, per = word_hashes(*flat_bytes(column))
        owner = np.repeat(np.arange(n), per)
        at = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
        hit = words[at] == hashes if len(words) else np.zeros(len(hashes), bool)
        base = np.bincount(owner[hit], value[at[hit]], n) + math.log10(ends + 0.5) - scale
        known = np.bincount(owner[hit], minlength=n) + (ends > 0)
        words_left = _counted(hashes[~hit], owner[~hit], n)
        gram, size = grams(column)
        code, own = pd.factorize(gram)
        at = np.minimum(np.searchsorted(often, own), max(len(often) - 1, 0))
        hit = often[at] == own if len(often) else np.zeros(len(own), bool)
        sums = np.concatenate([[0.0], np.cumsum((np.where(hit, logs[at], 0.0) if len(often) else np.zeros(len(own)))[code])])
        stop = np.cumsum(size)
        miss = ~hit[code]
        grams_left = _counted(gram[miss], np.repeat(np.arange(n), size)[miss], n)
        yield pa.RecordBatch.from_arrays([pa.array(rid + np.arange(n)), batch.column(0), batch.column(1), pa.array(per + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(sums[stop] - sums[stop - size]), *words_left, *grams_left], names=[c.split()[0] for c in SCORED.split(", ")])
        rid += n


def fit(train: DataFrame, text: str = "text") -> tuple:
    """Counts of all training texts -> (model of all nodes, frequent grams, their scores, frequent words, their counts, tokens, distinct tokens, texts), and the table of word counts."""
    spark = train.sparkSession
    small_batches(spark)
    counts = stored(train.select(F.col(text).cast("string").alias("text")).mapInArrow(_count, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    totals = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    words, texts = (totals[k]["n"] if k in totals else 0 for k in (0, 2))
    tokens, distinct = words + texts, (totals[0]["v"] if 0 in totals else 0) + (texts > 0)
    symbols = totals[1]["n"] if 1 in totals else 0
    tree = Model(counts.where("kind = 1").select(F.col("key").alias("gram"), "n"))
    often = tree.frequent(max(1, -(-symbols // GRAM_SHARES))).toArrow().to_pandas().sort_values("gram")
    bar = max(1, -(-tokens // WORD_SHARES))
    vocabulary = counts.where("kind = 0").select("key", "n")
    top = vocabulary.where(F.col("n") >= bar).toArrow().to_pandas().sort_values("key", key=lambda k: k.to_numpy(np.int64).view(np.uint64))
    model = (tree, often["gram"].to_numpy(np.int64).view(np.uint64), often["log10"].to_numpy(float), top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), tokens, distinct, texts)
    return model, vocabulary.where(F.col("n") < bar)


def score(docs: DataFrame, train: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Null text counts as empty: the end alone. Very long texts are scored whole. Null ids, ties and repeated rows are rows like any other.
    Without training texts every binary decision has probability one half. Other columns are not carried, so their names cannot
    clash; an empty table gives no rows.
    """
    spark = docs.sparkSession
    model, rest = fit(train, text)
    shared = spark.sparkContext.broadcast(model[1:])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("string").alias("text"))
    scored = stored(rows.mapInArrow(lambda it: _score(it, shared), SCORED))
    tokens, distinct = model[5], model[6]
    sizes = scored.agg(F.sum(F.size("words")), F.sum(F.size("grams"))).first()
    left = lambda key, times: scored.select("rid", F.explode(F.arrays_zip(key, times)).alias("x")).select("rid", f"x.{key}", f"x.{times}").toDF("rid", "key", "times")
    words = left("words", "word_counts")
    counts = stored(words.groupBy("key").agg(F.count("*").alias("n")).join(rest.withColumnRenamed("n", "c"), "key", "left"))
    c = F.coalesce(F.col("c"), F.lit(0))
    more = F.sum(F.col("times") * (F.log10(c + 0.5) - math.log10(tokens + 0.5 * (distinct + 1))))
    terms = joined_by_key(words, counts, "key", sizes[0] or 0).groupBy("rid").agg(more.alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("more_known"))
    rare = left("grams", "gram_counts")
    found = stored(model[0].scores(rare.select(F.col("key").alias("gram"))).withColumnRenamed("gram", "key"))
    deep = joined_by_key(rare, found, "key", sizes[1] or 0).groupBy("rid").agg(F.sum(F.col("times") * F.col("log10")).alias("deep"))
    out = scored.drop("words", "word_counts", "grams", "gram_counts").join(terms, "rid", "left").join(deep, "rid", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("deep", F.lit(0.0))).alias("score"))
