"""Scans over slices against plain windows and loops."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tonelake.operators import ctc, evaluate, scans
from tonelake.streaming import logs

SCHEMA = "k string, a int, b int, v int, lag string"


def made(kind, n=400):
    rng = np.random.default_rng(5)
    keys = {"one": ["x"], "hot": ["x"] * 8 + ["y", None], "many": [f"k{i}" for i in range(150)]}[kind]
    rows = [(keys[rng.integers(len(keys))], int(rng.integers(0, 40)), i, None if rng.random() < 0.3 else int(rng.integers(-9, 9)), "clash") for i in range(n)]
    return [rows[i] for i in rng.permutation(n)]


@pytest.mark.parametrize("kind", ["one", "hot", "many"])
def test_scans_equal_windows(spark, kind):
    df = spark.createDataFrame(made(kind), SCHEMA)
    v = F.col("v")
    kinds = ["lag", "lead", "sum", "sum_before", "min_before", "last_known", "next_known"]
    got = scans.scan(df, "k", ["a", "b"], {f"o_{x}": (x, v) for x in kinds} | {"i": ("sum", F.lit(1))}, parts=9, keep_slice=True)
    assert got.select(scans.SLICE).distinct().count() == 9
    w = Window.partitionBy("k").orderBy("a", "b")
    upto, before, onward = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    plain = {"lag": F.lag(v).over(w), "lead": F.lead(v).over(w), "sum": F.sum(v).over(upto), "sum_before": F.sum(v).over(before), "min_before": F.min(v).over(before), "last_known": F.last(v, True).over(upto), "next_known": F.first(v, True).over(onward)}
    want = df.select("*", *[c.alias(f"o_{x}") for x, c in plain.items()], F.row_number().over(w).cast("long").alias("i"))
    order = lambda rows: sorted((tuple(r.asDict().items()) for r in rows), key=repr)
    assert order(got.drop(scans.SLICE).collect()) == order(want.collect())


def test_scans_of_nothing_and_of_one_row(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert scans.scan(df, "k", "a", {"o": ("lag", F.col("v"))}).count() == 0
    one = scans.scan(spark.createDataFrame([(None, None, 1, 5, None)], SCHEMA), "k", ["a"], {"o": ("sum", F.col("v")), "p": ("lag", F.col("v"))}).first()
    assert (one["o"], one["p"]) == (5, None)


def test_one_utterance_over_many_slices(spark):
    rng = np.random.default_rng(6)
    path = rng.integers(0, 4, 3000).tolist()
    rows = [("u", i, x) for i, x in enumerate(path)] + [("blank", i, 0) for i in range(5)] + [(None, 0, 3)]
    df = spark.createDataFrame(rows, "u string, t long, x int").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = {r["u"]: (r["frames"], r["text"]) for r in ctc.collapse_frames(df, "u", "t", "x").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    whole = spark.createDataFrame([(path,)], "p array<int>").select(ctc.collapse(F.col("p"))).first()[0]
    third = spark.createDataFrame([([3],)], "p array<int>").select(ctc.collapse(F.col("p"))).first()[0]
    assert got == {"u": (3000, whole), "blank": (5, ""), None: (1, third)}


def test_logs_of_one_long_run(spark):
    """One run with all epochs: streaks and best epochs over the bounds of slices, by a loop."""
    rng = np.random.default_rng(7)
    cer = rng.integers(0, 5, 500) / 100
    cer[100:300] = 0.001  # a streak longer than a slice
    df = spark.createDataFrame([("r", i, float(c)) for i, c in enumerate(cer)], "run string, epoch int, cer double").repartition(5)
    best, want, streak, streaks = np.inf, {}, [], []
    for i, c in enumerate([*cer, 1.0]):
        if c < 0.015:
            streak.append(i)
        elif streak:
            streaks.append((streak[0], streak[-1], len(streak), len(streak) >= 3))
            streak = []
        want[i], best = bool(c < best), min(best, c)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert {r["epoch"]: r["is_best"] for r in logs.improvements(df, "run").collect()} == {i: want[i] for i in range(500)}
        assert sorted(tuple(r)[1:] for r in logs.streaks(df, "run").collect()) == streaks
        deltas = {r["epoch"]: r["delta"] for r in evaluate.run_deltas(df, "run", "epoch", "cer").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert deltas[0] is None and all(np.isclose(deltas[i], cer[i] - cer[i - 1]) for i in range(1, 500))
