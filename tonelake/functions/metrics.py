"""Character and word error rates, and the bands built on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .text import words

BANDS = {"synthetic": ((0.05, "OK"), (0.25, "~"), (None, "FAIL")), "holdout": ((0.10, "OK"), (0.40, "~"), (None, "FAIL")), "audit": ((0.30, "GOOD"), (0.50, "MARG"), (None, "BAD"))}


#: Bounds that a distance is looked for within, one after another; beyond the last without one.
BOUNDS = (32, 512, 8192)


def distance(a: Column, b: Column) -> Column:
    """Edit distance of texts of any length. Within a bound only a band about the diagonal is filled, so close texts cost their length times their distance."""
    within = F.aggregate(F.array(*map(F.lit, BOUNDS)), F.lit(-1), lambda got, k: F.when(got >= 0, got).otherwise(F.call_function("levenshtein", a, b, k)))
    short = F.greatest(F.length(a), F.length(b)) <= BOUNDS[0]
    return F.when(short, F.levenshtein(a, b)).otherwise(F.transform(F.array(within), lambda d: F.when(d >= 0, d).otherwise(F.levenshtein(a, b)))[0])


#: Texts of up to so many characters are compared as bits, many pairs at a time.
SHORT = 512
#: Characters of the pairs that are held side by side.
CELLS = 1 << 18
_NONE, _ONE, _TOP, _ALL = np.uint64(0), np.uint64(1), np.uint64(63), ~np.uint64(0)


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a batch in a row, and how many each text has; null has none."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    signs = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if signs.max(initial=0) < 128:
        return signs, np.diff(ends)
    signs = np.frombuffer(signs.tobytes().decode().encode("utf-32-le"), np.uint32)
    return signs.astype(np.uint8) if signs.max() < 256 else signs, pc.utf8_length(texts).to_numpy().astype(np.int64)


def distances(signs: np.ndarray, at_x: np.ndarray, m: np.ndarray, at_y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of texts, the first of each not empty and not the longer one, in order of the second's length.

    The texts begin at ``at_x`` and ``at_y`` in ``signs``, which goes on past the last one by the longest length, and have ``m`` and ``n`` characters.
    Where the first text is the second without some signs, the distance is what is missing: no other way is shorter.
    """
    y = np.ascontiguousarray(sliding_window_view(signs, int(n[-1]))[at_y].T)
    first = np.searchsorted(n, np.arange(1, y.shape[0] + 2))  # the pairs that have a column j begin here
    to = at_x.copy()
    for j, lo in enumerate(first[:-1]):
        to[lo:] += signs[to[lo:]] == y[j, lo:]
    got, rest = n - m, np.flatnonzero(to - at_x < m)
    if len(rest):
        m, n = m[rest], n[rest]
        got[rest] = _distances(sliding_window_view(signs, int(m.max()))[at_x[rest]], m, y[: n[-1], rest], n)
    return got


def _distances(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The same for texts laid out, those of ``x`` a row each, those of ``y`` a column; what is behind a text's end is not looked at.

    Myers' method: a column of the table is kept as bits, whether it rises or falls from one place to the next (Hyyro's blocks of 64), and one
    step takes all pairs to their next column.
    """
    rows, words, got = len(m), x.shape[1] + 63 >> 6, n.copy()
    up, down = np.full((words, rows), _ALL), np.zeros((words, rows), np.uint64)
    bits = np.zeros((rows, words * 8), np.uint8)
    first = np.searchsorted(n, np.arange(1, y.shape[0] + 2))
    for j, (lo, hi) in enumerate(zip(first, first[1:])):
        bits[lo:, : x.shape[1] + 7 >> 3] = np.packbits(x[lo:] == y[j, lo:, None], axis=1, bitorder="little")
        equal, rise, fall = bits[lo:].view(np.uint64), _ONE, _NONE  # the first row grows by one a column
        for w in range(words):
            e, p, q = equal[:, w], up[w, lo:], down[w, lo:]
            v = e | q
            e = e | fall
            h = (((e & p) + p) ^ p) | e
            plus, minus = q | ~(h | p), p & h
            risen, fallen = plus << _ONE | rise, minus << _ONE | fall
            rise, fall = plus >> _TOP, minus >> _TOP
            up[w, lo:], down[w, lo:] = fallen | ~(v | risen), risen & v
        for w in range(words) if hi > lo else ():
            held = np.clip(m[lo:hi] - 64 * w, 0, 64).astype(np.uint64)
            mask = np.where(held > 0, _ALL >> (np.uint64(64) - np.maximum(held, _ONE)), _NONE)
            got[lo:hi] += np.bitwise_count(up[w, lo:hi] & mask).astype(np.int64) - np.bitwise_count(down[w, lo:hi] & mask)
    return got


@F.arrow_udf(IntegerType())
def _short_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distances of a batch; null where either is. Pairs of like lengths are put side by side, the shorter text as bits."""
    (x, m), (y, n) = _characters(a), _characters(b)
    at_x, at_y = np.cumsum(m) - m, np.cumsum(n) - n + len(x)
    at_x, at_y = np.where(m > n, at_y, at_x), np.where(m > n, at_x, at_y)
    short, out = np.minimum(m, n), np.maximum(m, n)  # from nothing, every character is an edit
    signs = np.concatenate([x, y, np.zeros(int(out.max(initial=0)) + 1, np.uint8)])
    known = pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False)
    long, order = out.copy(), np.lexsort((out, short + 63 >> 6))
    for words in range(1, (int(short.max(initial=0)) + 63 >> 6) + 1):
        at = order[short[order] + 63 >> 6 == words]
        while len(at):
            size = min(len(at), CELLS // int(long[at[0]]) + 1)
            size = max(1, min(size, CELLS // int(long[at[size - 1]])))
            part, at = at[:size], at[size:]
            out[part] = distances(signs, at_x[part], short[part], at_y[part], long[part])
    return pa.array(out.astype(np.int32), mask=~known)


def pair_distance(a: Column, b: Column) -> Column:
    """``distance``, but texts of up to ``SHORT`` characters go to Python tasks in Arrow batches. Not for lambdas."""
    short = (F.greatest(F.length(a), F.length(b)) <= SHORT) & F.is_valid_utf8(a) & F.is_valid_utf8(b)
    return F.when(short, _short_distance(F.when(short, a), F.when(short, b))).otherwise(distance(a, b))


def _nospace(x: Column) -> Column:
    return F.upper(F.replace(x, F.lit(" "), F.lit("")))


def cer(pred: Column, target: Column, variant: str = "nospace") -> Column:
    """Edit distance by the target's length. ``nospace``: upper case without spaces; ``spaces``: as it is; ``first``: by the first text's length."""
    p, t = pred, target
    if variant == "nospace":
        p, t = _nospace(pred), _nospace(target)
    by = F.length(p) if variant == "first" else F.length(t)
    return F.when(by == 0, F.when(F.length(p) == F.length(t), 0.0).otherwise(1.0)).otherwise(pair_distance(p, t) / by)


def with_cer(pairs: DataFrame, pred: str, target: str, name: str = "cer") -> DataFrame:
    """The ``nospace`` rate of each row as a column. The texts without spaces are columns first, as one expression would name them in 26 places."""
    rows = pairs.select("*", _nospace(F.col(pred)).alias("__pred"), _nospace(F.col(target)).alias("__target"))
    return rows.select(*pairs.columns, cer(F.col("__pred"), F.col("__target"), "spaces").alias(name))


def _character(n: Column) -> Column:
    """A character of its own for each number from 1 on, past those that UTF-16 keeps for its pairs."""
    at = F.when(n < 55_040, n + 256).otherwise(n + 2304)
    pair = F.concat(F.hex(55_232 + F.shiftright(at, 10)), F.hex(56_320 + at.bitwiseAND(F.lit(1023))))
    return F.decode(F.unhex(F.when(at < 65_536, F.lpad(F.hex(at), 4, "0")).otherwise(pair)), "UTF-16BE")


def wer(pred: Column, target: Column) -> Column:
    """The same over words: each distinct word of the pair becomes one character, so the built-in distance does the work.

    Good for a million distinct words in a pair. Its work grows with the length times the distance, so a long pair that has little in common is dear.
    """
    p, t = words(F.upper(pred)), words(F.upper(target))
    one = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731 - what a lambda is given is computed once
    spell = lambda ws, known: F.array_join(F.transform(ws, lambda w: _character(F.array_position(known, w))), "")
    texts = lambda x: one(F.struct(x["p"].alias("p"), x["t"].alias("t"), F.array_distinct(F.concat(x["p"], x["t"])).alias("known")), lambda y: F.struct(spell(y["p"], y["known"]).alias("p"), spell(y["t"], y["known"]).alias("t")))
    rate = lambda x: one(texts(x), lambda y: distance(y["p"], y["t"])) / F.size(x["t"])
    return one(F.struct(p.alias("p"), t.alias("t")), lambda x: F.when(F.size(x["t"]) == 0, F.when(F.size(x["p"]) == 0, 0.0).otherwise(1.0)).otherwise(rate(x)))


def band(value: Column, profile: str) -> Column:
    out = None
    for limit, name in BANDS[profile]:
        if limit is None:
            return out.otherwise(name)
        out = F.when(value < limit, name) if out is None else out.when(value < limit, name)
    return out


def accuracy_proxy(value: Column) -> Column:
    return 1 - F.least(value, F.lit(1.0))
