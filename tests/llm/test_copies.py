"""Near copies of texts and vectors, and components, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.llm import common, near_copies, vector_copies
from tonelake.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def component_of(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(0, 60)] + [tuple(map(int, rng.integers(70, 300, 2))) for _ in range(150)] + [(5, 5), (5, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = component_of(300, [x for x in links if None not in x])
    assert got == {i: want[i] for i in got} and set(got) == {x for a, b in links if b is not None and a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def made_texts():
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(WORDS, 80)) for _ in range(12)]
    texts = []
    for b in base[:6]:  # copies with 0 to 12 changed words
        for k in range(25):
            w = b.split()
            for at in rng.integers(0, len(w), k // 2):
                w[at] = str(rng.choice(WORDS))
            texts.append(" ".join(w))
    passage = " ".join(rng.choice(WORDS, 60))
    texts += [f"{passage} {' '.join(rng.choice(WORDS, 50))}" for _ in range(40)]  # a common passage is no link
    texts += [None, "", "  \n", "one two", "One  TWO", "one", *base, *base[:3], "Å é", "x " * 5000]
    return texts


@pytest.mark.parametrize("width", [4, 5])
def test_near_copies_equal_all_pairs(spark, width, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 16)  # several blocks a meeting
    monkeypatch.setattr(common, "HOT", 1 if width == 5 else common.HOT)  # no key is hot; else all are
    texts = made_texts()
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = near_copies.near_copies(docs.withColumn("sig", F.lit(5)), width=width, keep=["sig"]).collect()
    assert {r["sig"] for r in got} == {5}
    sets = [shingles(t, width) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = component_of(len(texts), links)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))}
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


@pytest.mark.parametrize("ids", [(1, 5, 5, 9), (5, 1, 9, 5), (9, 5, 1, 5), (5, 9, 5, 1), (5, 5, 1, 9), (5, 5, 5, 5)])
def test_texts_that_share_an_id(spark, ids):
    """Two pairs of near copies, ids in all places: each pair is a component of its own, with one first class."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    texts = [a, a + " q", b, b + " z"]
    got = near_copies.near_copies(spark.createDataFrame([(i, t, t[0]) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, pair string"), keep=["pair"]).collect()
    for pair, own in (("a", ids[:2]), ("b", ids[2:])):
        rows = [r for r in got if r["pair"] == pair]
        assert {r["component_id"] for r in rows} == {min(own)} and sum(r["first"] for r in rows) == 1 and len({r["class_id"] for r in rows}) == 2
        assert all(r["kept"] == (r["doc_id"] == min(own)) for r in rows) and all(r["kept"] for r in rows if r["first"])


def test_repeated_ids_against_all_pairs(spark, monkeypatch):
    """Random ids with repetitions over copies, near copies and repeated rows, in meetings of one block and of many."""
    texts = [t for t in made_texts() if t and t.strip()]
    rng = np.random.default_rng(9)
    rows = [(int(i), t) for i, t in zip(rng.integers(0, 60, len(texts)), texts, strict=True)]
    rows += rows[:40]
    sets = [shingles(t, 5) for _, t in rows]
    label = component_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(least.get(c, i), i)
    want = sorted((i, t, least[c]) for (i, t), c in zip(rows, label, strict=True))
    for block in (1024, 16):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), keep=["text"]).collect()
        assert sorted((r["doc_id"], r["text"], r["component_id"]) for r in got) == want
        heads = {r["class_id"] for r in got if r["first"]}
        assert len(heads) == len(set(label))


@pytest.mark.parametrize("rounds", [0, 4])
def test_large_meetings_lose_no_link(spark, rounds, monkeypatch):
    """Chains and rings of near copies around hot documents, in meetings of many blocks, with and without the rounds against one document."""
    monkeypatch.setattr(near_copies, "BLOCK", 20)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    rng = np.random.default_rng(6)
    text = [f"a{i}" for i in range(120)]
    texts = []
    for start in range(2):
        for k in range(90):  # each next one has one word more of another text
            w = list(text)
            for at in range(0, k // 2):
                w[(at * 7 + 3 * start) % 120] = f"b{start}{at}"
            for at in rng.integers(0, 120, 2):
                w[at] = f"c{rng.integers(0, 1000)}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts)) + [(0, " ".join(text[::-1])), (3, texts[5])]  # ids that repeat
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    sets = [shingles(t, 2) for _, t in rows]
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = component_of(len(texts), links)
    assert len(set(want)) < 60
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] not in (0, 3)} == {(i, want[i]) for i in range(len(texts)) if i not in (0, 3)}


def test_skips_lose_no_collision():
    rng = np.random.default_rng(7)
    signatures = rng.integers(0, 3, (80, 32)).astype(np.uint32)
    signatures[:40, :20] = signatures[0, :20]
    hits = (signatures[:, None] == signatures[None]).sum(2)
    for i, later, count in near_copies.candidates(signatures, 14):
        want = [j for j in range(i + 1, 80) if hits[i, j] >= 14]
        assert set(want) <= set(later.tolist()) and count(later, i).tolist() == hits[i, later].tolist()


def test_near_copies_of_nothing(spark):
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_copies.near_copies(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector_copies, "BLOCK", 40)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((8, 16))
    x = [b + s * rng.standard_normal(16) for b in base for s in np.repeat([0.0, 0.05, 0.12, 0.25], 8)] + list(rng.standard_normal((60, 16)))
    rows = [(i, [float(v) for v in y], i % 3 if i % 10 else None) for i, y in enumerate(x)]
    n = len(rows)
    bad = [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0, None] * 8, 1), (n + 4, [float("inf")] * 16, 1), (n + 5, [1.0] * 4, 1), (None, rows[1][1], 1), (n + 6, [], 1)]
    got = vector_copies.vector_copies(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")).collect()
    u = np.stack(x) / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.93
    links = [(i, j) for i in range(n) for j in range(n) if i != j and close[i, j] and rows[i][2] is not None and rows[i][2] == rows[j][2]]
    want = component_of(n, links)
    degree = np.bincount([a for a, _ in links], minlength=n)
    have = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == n + len(bad)
    for i in range(n):
        assert have[i] == (degree[i], want[i], want[i] == i)
    for i in range(n, n + 7):
        assert have[i] == (0, i, True)
    assert have[None] == (0, None, True)


def test_vectors_of_any_length_and_label(spark):
    """Very long and short vectors, text labels, ids that repeat, columns that clash."""
    rows = [(1, [1e-200, 1e-200], "x", 9), (2, [1e200, 1e200], "x", 9), (3, [3.0, 3.1], "x", 9), (4, [5e-324, 0.0], "x", 9), (5, [1e308, 0.0], "x", 9), (6, [1.0, 1.0], "y", 9), (7, [2.0, 2.0], "y", 9), (7, [2.0, 2.0], "y", 9), (8, [1.0, 1.0], None, 9)]
    got = vector_copies.vector_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, n_links int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 2, 6), (7, 2, 6), (7, 2, 6), (8, 0, 8)]


def test_vectors_shipped_grow_in_proportion(spark, monkeypatch):
    """On clustered data what is shipped grows with the probes: five times the vectors, about five times the rows."""
    monkeypatch.setattr(vector_copies, "BLOCK", 64)
    rng = np.random.default_rng(5)
    shipped = []
    for n in (1000, 5000):
        centres = rng.standard_normal((n // 50, 32))
        x = centres[np.arange(n) % len(centres)] + 0.05 * rng.standard_normal((n, 32))
        classes = spark.createDataFrame([(i, "a", y.tobytes(), 1) for i, y in enumerate(x)], "node long, label string, vec binary, copies long")
        shipped.append(vector_copies._dealt(vector_copies._index(classes, 0.93)[1]).count())
    assert shipped[0] >= 2000 and shipped[1] < 9 * shipped[0] and shipped[1] < 10 * 5000, shipped


def test_no_vectors(spark):
    assert vector_copies.vector_copies(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert vector_copies.vector_copies(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")).first()["n_links"] == 0
