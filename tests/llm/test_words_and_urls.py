"""Spelling variants, collocations and URL filters against plain Python, and their queries against SQL."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.llm import collocations, spelling, url_filter
from tonelake.llm.queries import QUERIES, URL_RULES
from tonelake.llm.twins import SQL

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(SQL))
def test_twins(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda df: sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()), key=repr)
    assert order(got) == order(want)


# --- spelling ---


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least=3):
    counts = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                counts[w] += 1
    n = {w: c for w, c in counts.items() if c >= least}
    near, by_size = collections.defaultdict(set), collections.defaultdict(list)
    for w in n:
        by_size[len(w)].append(w)
    for size, words in by_size.items():
        for a in words:
            near[a] |= {b for s in (size - 1, size, size + 1) for b in by_size.get(s, []) if b != a and one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def variants_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("shard", [16, 8192])
def test_variants_equal_all_pairs(spark, monkeypatch, shard):
    """Words of few letters, so that near pairs, repeated letters and chains abound; one shard, and many."""
    monkeypatch.setattr(spelling, "SHARD", shard)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aabé"), rng.integers(4, 8))) for _ in range(260)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÀÉÿ÷×", "x" * 3000, "x" * 3001]
    weights = 1 / np.arange(1, len(words) + 1)
    rows = [(int(i), " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choice(words, 60, p=weights / weights.sum()))) for i in range(150)]
    rows += [(None, "aaaaa bbbbb"), (1, None), (2, ""), (3, "1234 _"), (4, f"{'x' * 3000} {'x' * 3001} ÀÉÿ÷× " * 3), *rows[:3]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string")
    got = spelling.variants(df)
    assert got.count() == len(variants_of(got)) and variants_of(got) == plain_variants(rows)


def test_variants_of_a_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert variants_of(QUERIES["op11_spelling_variants"](spark, SF)) == plain_variants(rows)


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "only twice twice")], "doc_id long, text string")).count() == 0


def test_checksums_combine():
    rng = np.random.default_rng(1)
    prefixes = [f"{i}:".encode() for i in rng.integers(0, 10**9, 20)] + [b""]
    table = spelling.checksums(prefixes)
    for k in (0, 1, 5, 64):
        tail = rng.bytes(k)
        assert [int(x) ^ zlib.crc32(tail) for x in table[:, k]] == [zlib.crc32(p + tail) for p in prefixes]


def test_index_counts_and_order():
    """Intervals grown to both sides hold as many places as the text has, and suffixes stand in order."""
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(2, 7))) for _ in range(90)})
    index, text = spelling.Index(words), "|" + "|".join(words) + "|"
    code = lambda c: np.array([index.BAR if c == "|" else 2 + "abc".index(c)])
    for pattern in ("a", "ab|", "|a", "abca", "c|b", "|", "bb"):
        for cut in range(len(pattern) + 1):
            state = [np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([index.n])]
            for c in reversed(pattern[:cut]):
                state = index.grow(state, code(c), False)
            for c in pattern[cut:]:
                state = index.grow(state, code(c), True)
            assert state[2][0] == sum(text.startswith(pattern, i) for i in range(len(text)))
    order = spelling.suffix_array(np.array([2, 1, 2, 1, 2, 0]))
    assert order.tolist() == [5, 3, 1, 4, 2, 0]


# --- collocations ---


def plain_collocations(rows, threshold, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        n[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[(lang, *w[i : i + k])] += 1
    out = []
    for p, a in f.items():
        if len(p) < 3 or a < threshold:
            continue
        longer = [c for q, c in f.items() if len(q) > len(p) and c >= threshold and q[0] == p[0] and any(q[1 + i : 1 + i + len(p) - 1] == p[1:] for i in range(len(q) - len(p) + 1))]
        if any(100 * c >= 80 * a for c in longer):
            continue
        score, _, l, r = min(((2_000_000 * a) // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1))
        out.append((p[0], " ".join(p[1:]), a, l, r, n[p[0]], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(mine, 1)]
    return sorted(ranked)


@pytest.mark.parametrize("odd", [False, True])
def test_collocations_equal_plain_counts(spark, odd):
    # odd: summaries that are cut and passed on early, slices of a few texts, a map in which most bits are shared
    limits = collocations.Limits(map_bits=10, held=100, counters=16, text=4000) if odd else collocations.LIMITS
    rng = np.random.default_rng(5)
    pool = ["the", "THE", "of", "é", "ß", "New", "York", "a\x00b", "x" * 300, "文"]
    weights = np.array([9, 3, 6, 3, 2, 5, 5, 1, 1, 1]) / 36
    glue = [" ", " ", " ", "\t", "  ", ". ", "\n", ", "]
    rows = [("".join(w + g for w, g in zip(rng.choice(pool, 50, p=weights), rng.choice(glue, 50))), [None, "en", "und", "de"][i % 4]) for i in range(70)]
    rows += [(None, "en"), ("", None), ("...", "fr"), ("new york new york " * 40, "fr"), *rows[:2]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, n int").repartition(6)
    got = collocations.collocations(df, threshold=12, top=15, limits=limits)
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got.columns == cols and sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 12, 15)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).count() == 0


@pytest.mark.parametrize("capacity", [4, 50, 100_000])
def test_summaries_keep_all_that_is_frequent(capacity):
    rng = np.random.default_rng(6)
    for _ in range(20):
        keys = np.minimum(rng.zipf(1.3, 4000), 3000).astype(np.uint64)
        total, exact = collocations.Summary(30, capacity), collections.Counter(keys.tolist())
        for part in np.array_split(keys, 17):
            total.add(*np.unique(part, return_counts=True))
        have = dict(zip(total.keys.tolist(), total.counts.tolist(), strict=True))
        assert total.error < 30
        assert all(have.get(k, 0) <= n <= have.get(k, 0) + total.error for k, n in exact.items())
        assert all(k in have for k, n in exact.items() if n >= 30)


def test_summaries_are_merged_side_by_side(spark):
    """All partitions' summaries are made in one job: a job each, one after another, grew with the table."""
    rows = spark.createDataFrame([("en", "a b c d e f")] * 40, "lang string, text string").repartition(4)
    spark.sparkContext.setJobGroup("summaries", "")
    try:
        bits = collocations.frequent_bits(rows, (1, 2), 30, 500)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.unpackbits(bits).sum() == 11
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("summaries")) <= 4


def test_small_parts_are_merged_together(monkeypatch):
    """A merge costs as much as the summary is large, so many small parts are merged at once; counts of 32-bit keys are exact."""
    import pyarrow as pa

    sizes = []
    plain = collocations.Summary.add
    monkeypatch.setattr(collocations.Summary, "add", lambda self, keys, counts: (sizes.append(len(keys)), plain(self, keys, counts)))
    keys = np.arange(100, dtype=np.uint32) << np.uint32(24)
    parts = [(p, keys.tobytes(), np.full(100, k).astype(np.uint8 if k < 256 else np.int64).tobytes()) for p in (0, 1) for k in [1] * 200 + [300] * p]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*parts)], names=["part", "keys", "counts"])
    got = list(collocations._survivors([batch], 300, 1, collocations.Limits(map_bits=10)))
    assert sizes == [20_000, 20_100]
    assert [np.unpackbits(np.frombuffer(b.column(1)[0].as_py(), np.uint8)).sum() for b in got] == [0, 100]


def test_exact_counts_are_shipped_in_blocks(spark):
    """A row for each partition and task, not for each phrase; languages may hold line feeds, counts and lengths may pass a byte."""
    import pyarrow as pa

    rows = [("w%d w%d " % (i % 90, i % 7) + "y" * 300, ["en", "x\ny", "\n", None][i % 4]) for i in range(900)] + [("new york " * 400, "\n")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] or "und" for r in rows]), pa.array([r[0] for r in rows])], names=["lang", "text"])
    every = type("Known", (), {"value": np.full(1 << 7, 255, np.uint8)})
    blocks = list(collocations._exact([batch], every, 2, collocations.LIMITS))
    assert sum(b.num_rows for b in blocks) == 4 and sum(sum(b.column(1).to_pylist()) for b in blocks) > 400
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), threshold=5, top=50).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, 5, 50)


def test_words_of_all_lengths():
    import pyarrow as pa

    texts = ["abcdefg", "ABCDEFG\x00", "abcdefgh", "abcdefg\x07", "abcdefgh\x00", "x" * 16, "x" * 17, "x" * 40 + "y", "x" * 40 + "z", "", "\x00", "\x00\x00", "é" * 3, "é" * 4, "x" * 16]
    words = collocations.Words(pa.array([*texts, None, " ".join(texts)]))
    number, names = words.numbered()
    lower = [t.translate(LOWER) for t in texts if t]
    assert [names[k] for k in number] == lower * 2 and len(names) == len(set(lower)) == len(set(words.hash.tolist()))
    assert words.piece.tolist() == [*range(len(lower)), *[len(lower)] * len(lower)]


def test_words_with_equal_hashes(monkeypatch):
    """Words are told apart by their bytes even if all hashes are the same."""
    import pyarrow as pa

    monkeypatch.setattr(collocations.Words, "_hashes", lambda self: np.zeros(len(self), np.uint64))
    words = collocations.Words(pa.array(["a b a", None, "", "B c, é a"]))
    number, names = words.numbered()
    assert [names[k] for k in number] == ["a", "b", "a", "b", "c", "é", "a"] and len(set(names)) == 4
    assert words.piece.tolist() == [0, 0, 0, 1, 1, 2, 2]


# --- urls ---


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Www.Example.COM/en/x?q#f", "a://b://c/d", "x://É.Com?p/en/", "x://user:pw@HOST.co.uk:80/a b\n/c#x", "x://[::1]:8/p", "x://10.0.0.1/es/", "x://net/es/1", "x://a.net/es", "x://notexample.com/en/", "x://example.com/en/", "x://a.www.example.com/en/", "x://com", "x://h/" + "p" * 100_000]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(None, "x://a.net/fr/", None), (4, urls[4], None)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string"), URL_RULES).collect()
    assert len(got) == len(rows)

    def plain(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        return host.translate(LOWER), re.match("[^?#]*", rest[len(host) :])[0]

    fits = lambda h, p, r: (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and p.startswith(r[r.index("/") :])
    for r in got:
        if r["page_id"] is not None:
            host, path = plain(urls[r["page_id"]])
            rule = max((t for _, t in URL_RULES if fits(host, path, t)), key=len, default=None)
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            if rule:
                assert r["verdict"] == {t: v for v, t in URL_RULES}[rule]
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.fitting(F.lit("a"), F.lit("/"), [("block", f"{i}/") for i in range(1001)])


def test_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "b.co.uk": ("b.co.uk", "co.uk"), "x.b.co.uk:80": ("b.co.uk", "co.uk"), "u@x.de.": ("x.de", "de"), "com": ("com", "com"), "10.1.2.3:8080": ("10.1.2.3", "10.1.2.3"), "[::1]": ("[::1]", "[::1]"), "": ("", "")}
    d, s = url_filter.domain_and_suffix(F.col("h"))
    got = {r["h"]: (r["d"], r["s"]) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", d.alias("d"), s.alias("s")).collect()}
    assert got == hosts


def test_reputation_is_shrunk_and_bounded(spark):
    """Bad hosts with much evidence go; one bad page of an unknown or good domain blocks nothing; new hosts of a bad domain go with it; without labels all stay."""
    rows = []
    for host, bad, n in [("spam.bad.com", 190, 200), ("a.bad.com", 95, 100), ("b.bad.com", 97, 100), ("c.bad.com", 90, 100), ("new.bad.com", 0, 0), ("good.com", 2, 300), ("x.good.com", 0, 100), ("y.good.com", 1, 1), ("z.good.com", 1, 50), ("lone.org", 1, 1), ("fresh.net", 0, 0), ("other.com", 3, 200)]:
        rows += [(f"x://{host}/{i}", int(i < bad)) for i in range(n)] + [(f"x://{host}/new", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, label int")
    got = {r["host"]: r["verdict"] for r in url_filter.judge(df, [], F.col("label")).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"spam.bad.com", "a.bad.com", "b.bad.com", "c.bad.com", "new.bad.com"}
    assert {r["verdict"] for r in url_filter.judge(df.drop("label"), []).collect()} == {"allow"}
