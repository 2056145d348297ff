"""Scores of a character model: looked up in a table by each task, by a join, and by a plain loop."""

import math

import pytest

from tonelake.operators import ctc

TEXTS = [(1, "ABABAC"), (2, "AB"), (3, ""), (4, None), (5, "ZZZZ"), (6, "ABZAB"), (6, "CABAB"), (7, "é\U0010ffffAB \0A"), (None, "BABA")]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("limits", [(10**6, 1 << 20), (10**6, 0), (0, 0)])
def test_scores_equal_a_plain_loop(spark, monkeypatch, n, limits):
    monkeypatch.setattr(ctc, "MODEL_ROWS", limits[0])
    monkeypatch.setattr(ctc, "PLACES", limits[1])
    lm = ctc.ngram_lm(spark.createDataFrame([("ABABCAB CAB",), ("BAé AB",)], "t string"), "t", n)
    seen = {(r["context"], r["ch"]): r["logp"] for r in lm.collect()}
    unseen, size = {r["context"]: r["unseen"] for r in lm.collect()}, lm.first()["v"]
    want = {}
    texts = [x for x in TEXTS if limits[0] or x[0] != 7]  # the join's n-grams are those of the basic plane
    for k, t in texts:
        for i in range(len(t or "") - n + 1):
            context, ch = t[i : i + n - 1], t[i + n - 1]
            score, count = want.get(k, (0.0, 0))
            want[k] = score + seen.get((context, ch), unseen.get(context, -math.log(size))), count + 1
    got = ctc.lm_score(spark.createDataFrame(texts, "k long, t string").coalesce(1), "k", "t", lm, n).collect()
    assert {r["k"]: r["n"] for r in got} == {k: count for k, (_, count) in want.items()}
    assert all(abs(r["score"] - want[r["k"]][0]) < 1e-9 for r in got)


def test_empty_model(spark):
    lm = ctc.ngram_lm(spark.createDataFrame([("A",)], "t string"), "t")
    assert [tuple(r) for r in ctc.lm_score(spark.createDataFrame([(1, "ABAB")], "k long, t string"), "k", "t", lm).collect()] == [(1, 0.0, 2)]


def test_no_row_for_each_gram(spark):
    """A small model is looked up in place: nothing of a text is exploded."""
    texts = spark.createDataFrame([(1, "ABAB")], "k long, t string")
    got = ctc.lm_score(texts, "k", "t", ctc.ngram_lm(texts, "t"))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
