"""Alignment, overlaps, percentiles and holdouts against plain loops over all they could have looked at."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.operators import label, splits
from tonelake.operators.percentiles import percentiles

TIMED = "array<struct<word:string,start_s:double,end_s:double>>"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def align(decoded, truth):
    out, at = [], 0
    for word in truth:
        low = max(0, at - 2)
        scored = [(distance(word, decoded[k][0].strip("=<>?")), k) for k in range(low, min(len(decoded), at + 5))]
        d, k = min(scored, default=(1 << 30, low))
        at = k + 1
        out.append([word, *(decoded[k][1:] if d <= max(2, len(word) // 2) else (None, None))])
    return out


def fill(words, gap=0.05):
    known = [i for i, w in enumerate(words) if w[1] is not None]
    out = [list(w) for w in words]
    if not known:
        return out
    for a, b in zip(known, known[1:]):
        for k in range(a + 1, b):
            out[k][1] = out[a][2] + (k - a) / (b - a) * (out[b][1] - out[a][2])
            out[k][2] = out[k][1] + out[a][2] - out[a][1]
    length = out[known[0]][2] - out[known[0]][1]
    for k in range(known[0] - 1, -1, -1):
        out[k][2] = out[k + 1][1] - gap
        out[k][1] = out[k][2] - length
    length = out[known[-1]][2] - out[known[-1]][1]
    for k in range(known[-1] + 1, len(out)):
        out[k][1] = out[k - 1][2] + gap
        out[k][2] = out[k][1] + length
    return out


def test_alignment_equals_a_loop(spark):
    rng = random.Random(3)
    pool = ["THE", "CAT", "HELLO", "WORLD", "A", "PARIS", "MORSE", "73", "É"]
    rows = [(0, [], ["A", "B"]), (1, None, ["A"]), (2, [("A", 0.0, 1.0)], []), (3, [("HELLO", 0.0, 1.0), ("=WORLD=", 2.0, 3.0)], ["HELLO", "WORLD", "AGAINST"]), (4, [("A", 0.0, 1.0)], None)]
    for i in range(60):
        truth = [rng.choice(pool) for _ in range(rng.randint(1, 40))]
        heard, t = [], 0.0
        for w in truth:
            if rng.random() < 0.15:
                continue
            t += rng.random()
            made = "".join(c if rng.random() > 0.15 else "?" for c in w) + ("=" if rng.random() < 0.1 else "")
            heard.append((made, round(t, 3), round(t + 0.4, 3)))
            if rng.random() < 0.1:
                heard.append(("NOISE?", t, t + 0.1))
        rows.append((10 + i, heard, truth))
    df = spark.createDataFrame(rows, f"k long, d {TIMED}, t array<string>")
    for filled in (False, True):
        got = {r["k"]: [tuple(w) for w in r["aligned"]] for r in label.align_words(df, "k", "d", "t", fill=filled).collect()}
        assert len(got) == len(rows)
        for k, d, t in rows:
            want = align(d or [], t or [])
            want = fill(want) if filled else want
            assert [w[0] for w in got[k]] == [w[0] for w in want]
            for x, y in zip(got[k], want, strict=True):
                assert x[1:] == tuple(y[1:]) or np.allclose(x[1:], y[1:], atol=1e-9)


def test_filled_times(spark):
    rows = [(1, i, w, s, e) for i, (w, s, e) in enumerate([("a", None, None), ("b", 2.0, 3.0), ("c", None, None), ("d", 6.0, 6.5), ("e", None, None)])] + [(2, 0, "a", None, None)]
    got = label.fill_times(spark.createDataFrame(rows, "k long, pos int, word string, start_s double, end_s double"), "k").orderBy("k", "pos").collect()
    assert [(round(r["start_s"], 3), round(r["end_s"], 3)) for r in got[:5]] == [(0.95, 1.95), (2.0, 3.0), (4.5, 5.5), (6.0, 6.5), (6.55, 7.05)]
    assert got[5]["start_s"] is None


def test_overlaps_of_all_lengths(spark):
    """Spans of a second to ten hours on both sides, nulls, ends that touch: all pairs, each once, from few rows."""
    rng = random.Random(5)
    span = lambda: (a := rng.choice([rng.random() * 40_000, float(rng.randint(0, 5000) * 8)]), a + rng.choice([0.0, 1.0, 8.0, 64.0, rng.random() * 600, rng.random() * 36_000]))
    chunks = [(k, i, *span()) for i in range(150) for k in [rng.choice([1, 2])]]
    segs = [(k, i, *span()) for i in range(150) for k in [rng.choice([1, 2])]] + [(1, 900, 0.0, 36_000.0)]
    left = spark.createDataFrame(chunks + [(1, 999, None, None)], "k long, c long, start_s double, end_s double")
    right = spark.createDataFrame(segs, "k long, s long, seg_start_s double, seg_end_s double")
    got = sorted((r["c"], r["s"]) for r in label.overlapping(left, right, "k").collect())
    assert got == sorted((c[1], s[1]) for c in chunks for s in segs if s[0] == c[0] and s[3] > c[2] and s[2] < c[3])
    assert set(label.overlapping(left, right, "k").columns) == {"k", "c", "start_s", "end_s", "s", "seg_start_s", "seg_end_s"}
    long = right.where("s = 900")
    assert label.placed(long, "seg_start_s", "seg_end_s", list(range(14)), 8.0).count() < 40
    assert label.overlapping(left.limit(0), right, "k").count() == 0


@pytest.mark.parametrize("few", [5, 50, 10_000])
def test_percentiles_equal_sorting(spark, few):
    rng = np.random.default_rng(4)
    values = {"wide": np.exp(rng.normal(0, 30, 700)), "same": np.full(400, 2.5), "ties": rng.integers(0, 3, 900) * 1e-3, "one": np.array([7.0]), "none": np.array([]), "huge": np.array([-1.7e308, 1.7e308, 0.0] * 30), "mixed": np.append(rng.random(500) * 1e-9, [1e9, -1e9])}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("none", None), ("wide", None), ("ties", float("nan")), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    wanted = {"a": 0.1, "b": 0.33, "c": 0.5, "d": 0.9, "e": 0.0, "f": 1.0}
    got = {r["k"]: r for r in percentiles(df, "k", "v", wanted, few=few).collect()}
    assert set(got) == set(values) | {None}
    for k, x in [*values.items(), (None, np.array([1.0, 3.0]))]:
        for name, q in wanted.items():
            if not len(x):
                assert got[k][name] is None
            elif k != "huge" or q in (0.0, 1.0):
                assert np.isclose(got[k][name], np.percentile(x, 100 * q), rtol=1e-9), (k, name)


def test_holdout_equals_the_steps(spark):
    """Random sources: the index gives what the steps over all sources give."""
    rng = random.Random(8)
    for case in range(6):
        rows = [(f"s{i}", rng.choice(["15", "20", "5", "30", "x", None]), rng.choice([1, 2, 3, 7, 20, 49, 50, 51, 60, 200])) for i in range(rng.choice([1, 4, 30, 300]))]
        order, target = ["15", "20", "5", "30", "10"], rng.choice([10, 50])
        pool, chosen, total = list(rows), [], 0
        steps = [(b, True) for b in order] + [(None, False)] * target
        for b, by_bucket in steps:
            if (by_bucket and total >= target and len(chosen) >= 2) or (not by_bucket and total >= target):
                continue
            some = [x for x in pool if not by_bucket or x[1] == b]
            if some:
                left = max(1, target - total)
                best = min(some, key=lambda x: (abs(x[2] - left), x[2], x[0]))
                pool.remove(best)
                chosen.append(best)
                total += best[2]
        got = splits.holdout_sources(spark.createDataFrame(rows, "s string, b string, n long"), "s", "b", order, target).collect()
        assert [tuple(r) for r in got] == chosen, case


def test_numbers_have_no_gaps(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b")).repartition(9, "b")
    got = splits.numbered(rows, ["a", "b"], parts=13).orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(5000)) and [(r["a"], r["b"]) for r in got] == sorted((i % 7, i) for i in range(5000))
