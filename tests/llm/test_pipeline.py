"""The pipeline's stages against their operators' rules, on a small table and on odd rows."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_copies import component_of, shingles

SF = "/root/testdata/sf0.01"
SECRET = re.compile(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, SF))
        assert docs.columns == cp.COLUMNS
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept["language ID"]) == {i for i, t in texts.items() if re.search(r"[^\W\d_]", t or "")}
    good, bad = ([i for i in kept["language ID"] if labels.get(i) == q] for q in (1, 0))
    assert sum(i in kept["quality classifier"] for i in good) >= 0.97 * len(good)
    assert sum(i in kept["quality classifier"] for i in bad) <= 0.2 * len(bad)
    ids = sorted(kept["quality classifier"])
    sets = [shingles(kept["quality classifier"][i]["text"], 5) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    first = component_of(len(ids), links)
    assert set(kept["near copies"]) == {ids[k] for k in range(len(ids)) if first[k] == k}
    assert set(kept["secret scan"]) == set(kept["near copies"])
    for i, r in kept["secret scan"].items():
        before = kept["near copies"][i]
        assert not SECRET.search(r["text"] or "")
        assert r["text"] == before["text"] or ("[SECRET]" in r["text"] and r["n_chars"] == len(r["text"]))
        if not SECRET.search(before["text"]) and not re.search(r"(?i)(passw|secret|token|api_?key)", before["text"]):
            assert r["text"] == before["text"]
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept["secret scan"])
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_odd_rows(spark):
    rows = [(None, "le texte est un texte de la langue", "fr", None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 !!", None, "s", 5), (4, "the words of the text " * 20, None, "s", 440), (4, "the words of the text " * 20, None, "s", 440), (5, "der text und die sprache", "de", "s", 24), (6, "the text of the words", "en", "s", 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.known_language(spark, docs, SF)
    got = [(r["doc_id"], r["lang"]) for r in out.collect()]
    assert sorted(x[0] or 0 for x in got) == [0, 4, 4, 5, 6] and all(x[1] for x in got)
    assert sorted(r["doc_id"] or 0 for r in cp.one_of_each_group(spark, docs, SF).collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert cp.without_secrets(spark, docs, SF).count() == len(rows)
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_one_id_with_two_texts_and_clashing_columns(spark):
    """Two texts under one id are judged each for itself; very long texts and extra columns do no harm."""
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(3, text, "en", "s", 1), (5, other, "en", "s", 2), (5, text, "en", "b", 3), (7, other + " x", "en", "s", 4), (8, "y " * 200_000, "en", "s", 5), (8, "y " * 200_000, "en", "a", 6)]
    docs = spark.createDataFrame([(*r, 1, "clash", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int, base string, rid double")
    got = cp.one_of_each_group(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in got) == [(3, 1), (5, 2), (8, 6)]
    assert cp.without_secrets(spark, docs, SF).columns == cp.COLUMNS
    assert cp.packed(spark, docs, SF).select("doc_id").distinct().count() == 4
    assert {r["doc_id"] for r in cp.known_language(spark, docs.select("*", docs["kept"].alias("lang_pred")), SF).collect()} == {3, 5, 7, 8}
    assert cp.good_quality(spark, docs, SF).columns == cp.COLUMNS
