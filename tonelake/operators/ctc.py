"""Turning a model's frame scores into text, and character n-gram models."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CHUNK_SECONDS, SAMPLE_RATE, VOCABULARY
from ..sources.io import stored
from .scans import joined_text, scan


def overlap_windows(df: DataFrame, key: str, n_samples: str, window: int = int(CHUNK_SECONDS) * SAMPLE_RATE, step: int = 7 * SAMPLE_RATE) -> DataFrame:
    """Windows with one second in common; what fits in one window stays whole."""
    n = F.col(n_samples)
    starts = F.when(n <= window, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, F.lit(step).cast("long")))
    return df.select(key, F.posexplode(starts).alias("pos", "start"), n.alias("__n")).select(key, "pos", "start", F.least(F.col("start") + window, F.col("__n")).alias("end"))


def score(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Scores of a user function, which is loaded once per worker; a failed batch's rows come back with the message in ``error``."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            try:
                yield fn(p).assign(error=None)
            except Exception as e:  # noqa: BLE001 - the message is part of the result
                yield pd.DataFrame({c.split()[0]: p.get(c.split()[0]) for c in schema.split(", ")}, index=p.index).assign(error=str(e))

    return df.mapInPandas(run, f"{schema}, error string")


def best_symbols(frames: Column) -> Column:
    """Number of the first highest score of each frame."""
    return F.transform(frames, lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def collapse(indices: Column) -> Column:
    """Text of a path: repeats and blanks go; a blank between equal signs keeps both."""
    placed = F.transform(indices, lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get(indices, i - 1)).alias("before")))
    kept = F.filter(placed, lambda e: (e["x"] != 0) & (e["before"].isNull() | (e["x"] != e["before"])))
    names = F.array(*map(F.lit, VOCABULARY))
    return F.array_join(F.transform(kept, lambda e: F.get(names, e["x"])), "")


def collapse_frames(frames: DataFrame, key: str, order: str, symbol: str) -> DataFrame:
    """``key, frames, text`` of a table with one row a frame (its best sign): the same as ``collapse``, for utterances of any length.

    A frame is compared with the one before it, also over the bounds of the slices that tasks work on.
    """
    rows = scan(frames.select(key, order, symbol), key, order, {"__before": ("lag", F.col(symbol))}, keep_slice=True)
    kept = (F.col(symbol) != 0) & (F.col("__before").isNull() | (F.col(symbol) != F.col("__before")))
    rows = rows.withColumn("__ch", F.when(kept, F.get(F.array(*map(F.lit, VOCABULARY)), F.col(symbol))))
    return joined_text(rows, key, order, "__ch").withColumnRenamed("n", "frames")


def reassemble(df: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """Texts of windows in order, without empty ones."""
    item = F.when(F.trim(text) != "", F.struct(F.col(pos), F.trim(text).alias("t")))
    return df.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), " ").alias("text"))


def ngrams(text: Column, n: int, include_last: bool) -> Column:
    """All overlapping runs of ``n`` characters of a transcript (characters of the basic plane), in one pass of a look-ahead."""
    every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return every if include_last else F.slice(every, F.lit(1), F.greatest(F.size(every) - 1, F.lit(0)))


def ngram_counts(texts: DataFrame, text: str, n: int = 3, include_last: bool = False) -> DataFrame:
    """How often a character follows the ``n - 1`` before it: ``context, ch, count``. The last n-gram of a text counts only on request."""
    grams = texts.select(F.explode(ngrams(F.col(text), n, include_last)).alias("g"))
    return grams.groupBy(F.substring("g", 1, n - 1).alias("context"), F.substring("g", n, 1).alias("ch")).agg(F.count("*").alias("count"))


def ngram_lm(texts: DataFrame, text: str, n: int = 3) -> DataFrame:
    """Add-one log-probabilities of every seen pair: ``context, ch, logp``, and ``unseen`` for any other character after the context."""
    counts = ngram_counts(texts, text, n)
    size = texts.select(F.explode(F.split(text, "")).alias("c")).where("c <> ''").agg(F.countDistinct("c").alias("v"))
    total = counts.groupBy("context").agg(F.sum("count").alias("total"))
    return counts.join(total, "context").join(F.broadcast(size)).select("context", "ch", F.ln((F.col("count") + 1) / (F.col("total") + F.col("v"))).alias("logp"), F.ln(1 / (F.col("total") + F.col("v"))).alias("unseen"), "v")  # ``size`` is one row


#: Rows of a model that are shared with every task; a larger one is joined by shuffle.
MODEL_ROWS = 1_000_000


def lm_score(texts: DataFrame, key: str, text: str, lm: DataFrame, n: int = 3) -> DataFrame:
    """Sum of log-probabilities of the characters after their contexts; a context that was never seen gives the uniform share.

    The model is a table of its own, written once. If it is small (over this alphabet it has at most 55 ** 3 rows), every task looks a text's
    n-grams up in it, and only one sum of each text is shuffled; a larger one is joined by shuffle.
    """
    model = stored(lm.select(F.concat("context", "ch").alias("g"), "context", "logp", "unseen", "v"))
    rows, size = model.agg(F.count("*"), F.max("v")).first()
    uniform = -math.log(size) if size else 0.0
    if rows <= MODEL_ROWS:
        known = model.toPandas()
        table = _GramTable(known["g"], known["logp"], known.drop_duplicates("context").set_index("context")["unseen"], uniform, n)
        shared = texts.sparkSession.sparkContext.broadcast(table)
        scored = F.arrow_udf(lambda t: shared.value.scores(t), "struct<score:double,n:long>")
        each = texts.where(F.length(text) >= n).select(key, scored(F.col(text)).alias("s"))
        return each.groupBy(key).agg(F.sum("s.score").alias("score"), F.sum("s.n").alias("n"))
    contexts = model.groupBy("context").agg(F.first("unseen").alias("unseen"))
    grams = texts.select(key, F.explode(ngrams(F.col(text), n, include_last=True)).alias("g"))
    joined = grams.join(model.select("g", "logp"), "g", "left").withColumn("context", F.substring("g", 1, n - 1)).join(contexts, "context", "left")
    return joined.groupBy(key).agg(F.sum(F.coalesce("logp", "unseen", F.lit(uniform))).alias("score"), F.count("*").alias("n"))


#: Entries of a level of the table below that is looked up by place; a larger one is searched.
PLACES = 1 << 20


def _places(level: np.ndarray, size: int) -> np.ndarray:
    out = np.full(size, len(level))
    out[level] = np.arange(len(level))
    return out


class _GramTable:
    """Log-probabilities by the numbers of n-grams: a gram's last sign is looked up in a row of its context, the last row is for all others."""

    def __init__(self, grams: pd.Series, logp: pd.Series, unseen: pd.Series, uniform: float, n: int):
        self.n = n
        signs = sorted({ord(c) for g in grams for c in g})
        self.number = np.full(max(signs, default=0) + 2, len(signs), np.int64)
        self.number[signs] = np.arange(len(signs))
        #: sorted numbers of the prefixes of each length, under the place of the prefix before; what is not there is the place past the end
        self.levels, place = [], np.zeros(len(grams), np.int64)
        ids = [self.number[[ord(g[i]) for g in grams]] for i in range(n)] if len(grams) else [np.zeros(0, np.int64)] * n
        self.width = len(signs) + 1
        for i in range(n):
            numbers = place * self.width + ids[i]
            self.levels.append(np.unique(numbers))
            place = np.searchsorted(self.levels[-1], numbers)
            if i == n - 2:
                context = place.copy()
        sizes = [(len(before) + 1) * self.width for before in [[], *self.levels[:-1]]]
        self.places = [_places(level, k) if k <= PLACES else None for level, k in zip(self.levels, sizes)]
        self.logp = np.zeros(len(self.levels[-1]) + 1)
        self.logp[place] = logp
        self.unseen = np.full((len(self.levels[-2]) if n > 1 else 1) + 1, uniform)
        if n > 1 and len(grams):
            self.unseen[context] = unseen.loc[[g[:-1] for g in grams]]
        elif len(grams):
            self.unseen[0] = unseen.iloc[0]

    def values(self, text: str) -> np.ndarray:
        """The log-probability of each character that has ``n - 1`` before it."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self.number[np.minimum(points, len(self.number) - 1)]
        count = len(ids) - self.n + 1
        place = before = np.zeros(count, np.int64)
        for i, (level, places) in enumerate(zip(self.levels, self.places)):
            numbers, before = place * self.width + ids[i : i + count], place
            if places is not None:
                place = places[numbers]
            else:
                at = np.searchsorted(level, numbers)
                place = np.where(level[np.minimum(at, len(level) - 1)] == numbers, at, len(level))
        return np.where(place < len(self.levels[-1]), self.logp[place], self.unseen[before])

    def scores(self, texts: pa.Array) -> pa.Array:
        got = [(float(v.sum()), len(v)) for v in (self.values(t.as_py()) for t in texts)]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.float64()), pa.array([k for _, k in got], pa.int64())], ["score", "n"])


def top_tokens(frame: Column, k: int) -> Column:
    """Numbers of the ``k`` highest scores of a frame, best first; of equal scores the first."""
    ranked = F.array_sort(F.transform(frame, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: x["i"])


def folded(frame: Column, width: int) -> Column:
    """A wide score vector as a frame of ``width`` signs: sign i has the best score of places i, i + width, ..."""
    places = lambda i: F.sequence(i, F.size(frame) - 1, F.lit(width))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_max(F.transform(places(i), lambda k: F.get(frame, k))))


class Contexts:
    """The last ``n - 1`` characters of texts as numbers, with a model's bonus for every sign after each; both are filled in as they are met."""

    def __init__(self, lm: dict | None, alpha: float, n: int, vocabulary: list[str]):
        self.lm, self.alpha, self.keep, self.vocabulary = lm, alpha, n - 1, vocabulary
        self.uniform = math.log(1 / max(1, lm["size"])) if lm else 0.0
        self.known, self.names = {}, []
        self.bonus, self.next = np.empty((0, len(vocabulary))), np.empty((0, len(vocabulary)), np.int64)
        self.number("")

    def number(self, context: str) -> int:
        if context not in self.known:
            self.known[context] = len(self.names)
            self.names.append(context)
            row = np.zeros(len(self.vocabulary))
            if self.lm:
                other = self.lm["unseen"].get(context, self.uniform)
                row = np.array([self.alpha * self.lm["logp"].get((context, v), other) for v in self.vocabulary])
            if len(self.names) > len(self.bonus):
                room = max(64, len(self.bonus))
                self.bonus = np.concatenate([self.bonus, np.empty((room, row.size))])
                self.next = np.concatenate([self.next, np.full((room, row.size), -1)])
            self.bonus[len(self.names) - 1] = row
        return self.known[context]

    def after(self, context: np.ndarray, sign: np.ndarray) -> np.ndarray:
        if not self.lm:
            return context
        for c, v in set(zip(*(x[self.next[context, sign] < 0].tolist() for x in (context, sign)), strict=True)):
            text = self.names[c] + self.vocabulary[v]
            self.next[c, v] = self.number(text[max(0, len(text) - self.keep) :])
        return self.next[context, sign]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def prefix_search(utterances: list[np.ndarray], lm: dict | None, width: int, alpha: float, n: int = 3, vocabulary: list[str] = VOCABULARY) -> list[str]:
    """Best texts of several utterances under their frame scores and a character model, a frame of all of them at a time.

    Probabilities of a text that ends in a blank or in its last sign are kept apart, so that a sign after a blank is a new one. A text is a hash of itself, a hash of
    it without its last sign, and that sign; which text it grew from is noted for each frame, so the work of a frame does not grow with the text. Only the
    best ``2 * width`` signs of a frame are looked at. Of equal scores the text that grew from a better one stays.
    """
    u, signs = len(utterances), len(vocabulary)
    lens = np.array([len(x) for x in utterances], np.int64)
    if not u or not lens.max():
        return [""] * u
    frames = np.zeros((u, int(lens.max()), signs))
    for k, x in enumerate(utterances):
        frames[k, : len(x)] = x
    contexts = Contexts(lm, alpha, n, vocabulary)
    top_n, none = min(2 * width, signs), -np.inf
    rows = np.arange(u)[:, None]
    blank, sign = np.full((u, width), none), np.full((u, width), none)
    blank[:, 0] = 0.0
    own = np.tile(np.arange(1, width + 1, dtype=np.uint64), (u, 1))
    parent, last, context = np.zeros((u, width), np.uint64), np.zeros((u, width), np.int64), np.zeros((u, width), np.int64)
    grew, said = [], []
    for t in range(frames.shape[1]):
        going = (lens > t)[:, None]
        top = np.argpartition(-frames[:, t], top_n - 1, axis=1)[:, :top_n]
        score = np.full((u, signs), none)
        score[rows, top] = frames[:, t][rows, top]
        both = np.logaddexp(blank, sign)
        # a sign more: from the blank alone where it is the last one again
        base = np.where(top[:, None, :] == last[:, :, None], blank[:, :, None], both[:, :, None])
        longer = base + score[rows, top][:, None, :] + contexts.bonus[context[:, :, None], top[:, None, :]]
        longer[np.broadcast_to((top == 0)[:, None, :], longer.shape)] = none
        # the same text: a blank, its last sign once more, or that sign said anew by the text it grew from, if that is still held
        stay_blank = both + score[:, :1]
        again = np.where(last > 0, sign + score[rows, last], none)
        from_ = parent[:, :, None] == own[:, None, :]
        held, slot = from_.any(2) & (last > 0), from_.argmax(2)
        anew = np.where(last[rows, slot] == last, blank[rows, slot], both[rows, slot]) + score[rows, last] + contexts.bonus[context[rows, slot], last]
        stay_sign = np.where(held, np.logaddexp(again, anew), again)
        taken = (from_ & held[:, :, None])[:, :, :, None] & (last[:, :, None, None] == top[:, None, None, :])
        longer[taken.any(1)] = none
        values = np.concatenate([np.logaddexp(stay_blank, stay_sign), longer.reshape(u, -1)], 1)
        best = np.argsort(-values, axis=1, kind="stable")[:, :width]
        stays = best < width
        at = np.where(stays, best, (best - width) // top_n)
        what = np.where(stays, 0, top[rows, (best - width) % top_n])
        fresh = values[rows, best]
        grown = _MIX * (own[rows, at] ^ (own[rows, at] >> np.uint64(29))) + (what.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        moved = {
            "blank": np.where(stays, stay_blank[rows, at], none), "sign": np.where(stays, stay_sign[rows, at], fresh), "parent": np.where(stays, parent[rows, at], own[rows, at]),
            "own": np.where(stays, own[rows, at], grown), "last": np.where(stays, last[rows, at], what), "context": np.where(stays, context[rows, at], contexts.after(context[rows, at], what)),
        }
        blank, sign, parent, own, last, context = (np.where(going, moved[k], x) for k, x in (("blank", blank), ("sign", sign), ("parent", parent), ("own", own), ("last", last), ("context", context)))
        grew.append(np.where(going, at, np.arange(width)))
        said.append(np.where(going, what, 0))
    slot = np.logaddexp(blank, sign).argmax(1)
    texts: list[list[int]] = [[] for _ in range(u)]
    for at, what in zip(reversed(grew), reversed(said), strict=True):
        for k in np.nonzero(what[np.arange(u), slot])[0].tolist():
            texts[k].append(int(what[k, slot[k]]))
        slot = at[np.arange(u), slot]
    return [" ".join("".join(vocabulary[i] for i in reversed(x)).split()) for x in texts]


#: Utterances that are searched together.
TOGETHER = 64


def beam(df: DataFrame, key: str, frames: str, lm: DataFrame | None = None, width: int = 16, alpha: float = 0.35, n: int = 3) -> DataFrame:
    """``key, text`` by prefix search. The model is a table of at most |alphabet| ** n rows, shared with every worker."""
    model = None
    if lm is not None:
        rows = lm.toArrow().to_pylist()
        model = {"logp": {(r["context"], r["ch"]): r["logp"] for r in rows}, "unseen": {r["context"]: r["unseen"] for r in rows}, "size": max((r["v"] for r in rows), default=1)}
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            every = [np.stack(f) if len(f) else np.empty((0, len(VOCABULARY))) for f in p[frames]]
            order, texts = sorted(range(len(every)), key=lambda k: len(every[k])), [""] * len(every)  # like lengths together
            for k in range(0, len(order), TOGETHER):
                own = order[k : k + TOGETHER]
                for i, text in zip(own, prefix_search([every[i] for i in own], shared.value, width, alpha, n), strict=True):
                    texts[i] = text
            yield pd.DataFrame({key: p[key], "text": texts})

    return df.select(key, frames).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, text string")
