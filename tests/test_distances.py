"""Edit distances of long pairs against the built-in one without bounds."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonelake.functions import metrics, text
from tonelake.plans import queries


def test_distance_equals_the_plain_one(spark):
    rng = random.Random(2)
    rows = [("", ""), ("a", ""), (None, "a"), ("a", None), ("é" * 50, "e" * 50), ("x" * 40, "y" * 1500)]
    for size in (5, 31, 33, 600, 1500):
        for share in (0.0, 0.01, 0.3, 0.9):
            a = "".join(rng.choice("abcdefgh") for _ in range(size))
            b = "".join(rng.choice("abcdefgh") if rng.random() < share else c for c in a if rng.random() > share / 3)
            rows.append((a, b))
    got = spark.createDataFrame(rows, "a string, b string").select(metrics.distance(F.col("a"), F.col("b")).alias("x"), F.levenshtein("a", "b").alias("y")).collect()
    assert all(r["x"] == r["y"] for r in got)


@pytest.mark.parametrize("changed", [0.01, 0.3])
def test_word_rates_of_long_pairs(spark, changed):
    """1,500 words a side: the rate is that of the plain distance over a sign for each word."""
    rng = random.Random(4)
    a = [rng.choice(["alpha", "beta", "gamma", f"w{i}"]) for i in range(1500)]
    b = [w if rng.random() > changed else rng.choice(["alpha", "new"]) for w in a if rng.random() > changed / 2]
    signs = {w: chr(0x4E00 + k) for k, w in enumerate(dict.fromkeys(a + b))}
    df = spark.createDataFrame([(" ".join(b), " ".join(a), "".join(signs[w] for w in b), "".join(signs[w] for w in a))], "p string, t string, x string, y string")
    got = df.select(metrics.wer(F.col("p"), F.col("t")).alias("got"), (F.levenshtein("x", "y") / F.length("y")).alias("want")).first()
    assert got["got"] == got["want"] > 0


def test_whole_documents(spark):
    """20,000 words a side, some replaced by words that stand nowhere else: each is one edit."""
    a = [f"w{i % 700}" for i in range(20_000)]
    b = [f"new{i}" if i % 400 == 7 else w for i, w in enumerate(a)]
    df = spark.createDataFrame([(" ".join(b), " ".join(a))], "p string, t string")
    assert df.select(metrics.wer(F.col("p"), F.col("t"))).first()[0] == 50 / 20_000


def test_pairs_side_by_side_equal_the_plain_distance(spark):
    """Lengths about the blocks of 64 bits and the bound of the batches, signs of one to four bytes, nothing and null."""
    rng = random.Random(6)
    rows = [(None, "a"), ("a", None), (None, None), ("", ""), ("", "abc"), ("a\0", "a")]
    for n in (1, 2, 31, 63, 64, 65, 127, 128, 129, 200, 511, 512, 513):
        for signs in ("ab", "abcdefgh", "aé\U0001f600z\0"):
            a = "".join(rng.choice(signs) for _ in range(n))
            b = "".join(c if rng.random() > 0.3 else rng.choice(signs) for c in a if rng.random() > 0.2) + "x" * rng.choice([0, 1, 70])
            rows += [(a, b), (b, a)]
    got = spark.createDataFrame(rows, "a string, b string").coalesce(1).select(metrics.pair_distance(F.col("a"), F.col("b")).alias("x"), F.levenshtein("a", "b").alias("y")).collect()
    assert len(got) == len(rows) and all(r["x"] == r["y"] for r in got)


def test_scored_chunks_are_not_stored(spark, monkeypatch):
    """Each chunk is read once; a table of them would be written for nothing."""
    monkeypatch.setattr(queries.io, "stored", lambda _: pytest.fail("stored"))
    for name in ("status_bands", "bucket_grouping_sets"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_cleaning_is_fast_and_takes_every_sign_alike(spark):
    """Every code point is replaced as by the class that the SQL uses, and far faster."""
    every = spark.range(0x110000).where("id < 55296 or id > 57343").select(F.concat(F.lit("A"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"), F.lit("B")).alias("t"))
    plain = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.upper(t), text.OUTSIDE, " "), " +", " "))
    assert every.select(F.count_if(~text.clean_vocab(F.col("t")).eqNullSafe(plain("t"))), F.count("*")).first() == (0, 0x110000 - 2048)
    long = spark.range(400, numPartitions=4).select(F.repeat(F.concat(F.lit("Some words, and more of them; "), "id"), 1500).alias("t")).persist()
    long.count()
    seconds = []
    for f in (text.clean_vocab, plain, text.clean_vocab, plain):
        start = time.time()
        long.select(F.sum(F.length(f(F.col("t"))))).collect()
        seconds.append(time.time() - start)
    assert 2 * seconds[2] < seconds[3], seconds


def test_texts_without_spaces_are_computed_once(spark, capsys):
    """Written into one expression they stood in the plan 26 times."""
    queries.bucket_grouping_sets(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out.split("AdaptiveSparkPlan")[-1]
    assert 0 < plan.count("replace(target") <= 4 and plan.count("upper(") <= 4, plan


def test_lost_signs_need_no_table(monkeypatch):
    """Pairs that differ by lost signs alone are told by one pass; only the others fill a table. All distances are the plain ones."""

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    filled, table = [], metrics._distances
    monkeypatch.setattr(metrics, "_distances", lambda x, m, y, n: (filled.append(len(m)), table(x, m, y, n))[1])
    rng = random.Random(8)
    for signs in ("abcdefgh", "aéz", "aé\U0001f600z\0"):
        whole = ["".join(rng.choice(signs) for _ in range(n)) for n in (1, 2, 30, 63, 64, 65, 100, 130)]
        lost = ["".join(c for k, c in enumerate(t) if k and rng.random() > 0.3) for t in whole]
        pairs = [*zip(lost, whole), *zip(whole, lost), (None, "a"), ("a", None), ("", "")]
        wrong = [(t + "Q", t + signs) for t in lost] + [(t[::-1] + "ab", t + "ba") for t in whole]
        for some, tables in ((pairs, 0), (pairs + wrong, len(wrong))):
            filled.clear()
            a, b = (pa.array(["left out", *side])[1:] for side in zip(*some))
            got = metrics._short_distance.func(a, b).to_pylist()
            assert got == [None if x is None or y is None else plain(x, y) for x, y in some]
            assert sum(filled) <= tables
    assert metrics._short_distance.func(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []


def test_runs_of_spaces(spark):
    df = spark.createDataFrame([("  a b  c   d\n\n e # f ",), (" ",), (" \n ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.clean_vocab(F.col("t"))).collect()] == ["A B C D E F", "", "", "", None]
