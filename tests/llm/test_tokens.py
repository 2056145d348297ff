"""Codec, prefix counts and packing against the libraries, on hand-made and random texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonelake.llm import packing, piece_codec, prefix_counts
from tonelake.llm.queries import BYTE_BPE, PIECE_MODEL

PARTS = ["a", "the", " ", "  ", "\n", "\t", "'", "ll", "'s", "é", "ß", "▁", "<|endoftext|>", "<|end", "123", "!!", "?", "ing", " world", "日本", "😀", "\x1c", "'re", "\x00", "\r\n", "ﬁ", "٣", "--------"]
SCHEMA = "doc_id long, text string, n_tokens string, ids int"


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture(scope="module")
def bpe():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts(n=250, seed=5):
    rng = random.Random(seed)
    made = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n)]
    return [None, "", " ", "▁", "  a", "a ", "x" * 3000, "word " * 20_000, *made, *made[:20]]


def table(spark, texts):
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(None, "no id", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_codec_equals_library(spark, sp):
    texts = odd_texts()
    got = {r["doc_id"]: r for r in piece_codec.encode_decode(table(spark, texts), PIECE_MODEL).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i]["ids"] == ids and got[i]["decoded"] == sp.decode(ids)
    digests = piece_codec.encode_decode(table(spark, texts[:20]), PIECE_MODEL, digests=True).where("doc_id = 9").first()
    ids = sp.encode(texts[9], add_bos=True, add_eos=True)
    assert digests["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert digests["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_codec_of_an_empty_table(spark):
    assert piece_codec.encode_decode(table(spark, []).limit(0), PIECE_MODEL).count() == 0


def test_every_prefix_equals_library(spark, bpe):
    texts = [t for t in odd_texts(120) if len(t or "") < 4000]
    got = {r["doc_id"]: r for r in prefix_counts.prefix_counts(table(spark, texts), *BYTE_BPE).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        places = range(len(t)) if len(t) < 200 else [0, len(t) // 2, len(t) - 1]
        for k in places:
            assert got[i]["prefix_tokens"][k] == len(bpe.encode(t[: k + 1], add_special_tokens=False).ids), (t, k)
        assert got[i]["n_tokens"] == len(bpe.encode(t, add_special_tokens=False).ids)
        assert got[i]["n_bytes"] == len(t.encode())


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_prefixes_of_any_text(t):
    exact = tokenizers.Tokenizer.from_file(BYTE_BPE[0])
    table = test_prefixes_of_any_text.__dict__.setdefault("table", None) or prefix_counts.PrefixTable(*BYTE_BPE)
    test_prefixes_of_any_text.table = table
    t = t.encode("utf-8", "ignore").decode()
    codes, _ = table.documents([t])
    within, lens = table.counts.take(codes)
    whole = within[np.cumsum(lens) - 1] if len(lens) else np.zeros(0, int)
    running = within + np.repeat(np.cumsum(whole) - whole, lens)
    assert running.tolist() == [len(exact.encode(t[: k + 1], add_special_tokens=False).ids) for k in range(len(t))]


def test_budget_answers(spark):
    df = prefix_counts.prefix_counts(table(spark, ["one two three four", ""]), *BYTE_BPE)
    r = {x["doc_id"]: x for x in df.select("doc_id", "n_tokens", prefix_counts.tokens_at(F.col("prefix_tokens"), F.lit(7)).alias("seven"), prefix_counts.characters_within(F.col("prefix_tokens"), F.lit(2)).alias("two")).collect()}
    assert (r[0]["n_tokens"], r[0]["seven"], r[0]["two"]) == (4, 2, 7)
    assert (r[1]["n_tokens"], r[1]["seven"], r[1]["two"]) == (0, 0, 0)
    got = {x["doc_id"]: x["within"] for x in prefix_counts.budget_counts(table(spark, ["one two three four", ""]), *BYTE_BPE, budget=2).collect()}
    assert (got[0], got[1]) == (7, 0)


def check_packing(rows, texts, bpe, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*bpe.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for k, r in enumerate(own):
            assert r["start"] == at and (r["length"] == capacity or k == 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq), -(-sum(r["length"] for r in rows) // capacity)


def test_packing(spark, bpe):
    texts = odd_texts(400, 9)
    for group in (10_000, 60):
        rows = packing.pack(table(spark, texts).where("doc_id is not null"), BYTE_BPE, capacity=64, group_rows=group).collect()
        used, least = check_packing(rows, texts, bpe, 64)
        assert used <= least * 1.01 + 1
    assert packing.pack(table(spark, []).limit(0), BYTE_BPE).count() == 0


def test_local_search_empties_bins():
    lengths = np.array([6, 4, 4, 3, 3])
    # a poor start: three bins where two are enough
    got = packing.improve([[0], [1, 2], [3, 4]], lengths, 10)
    assert len(got) == 2 and sorted(sum(got, [])) == [0, 1, 2, 3, 4]
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 700, 3000)
    start = [[i] for i in range(3000)]
    got = packing.improve(packing.best_fit(lengths, 2048), lengths, 2048)
    assert sorted(sum(got, [])) == list(range(3000)) and all(lengths[b].sum() <= 2048 for b in got)
    assert len(got) <= -(-lengths.sum() // 2048) + 1 < len(start)


@pytest.mark.parametrize("low,high,over", [(400, 1000, 1.06), (600, 760, 1.05), (1, 2049, 1.02), (1020, 1100, 1.001)])
def test_packing_of_hard_lengths(low, high, over):
    """Lengths that do not add up to full bins: no worse than best fit, near the bound, every piece once."""
    lengths = np.random.default_rng(low).integers(low, high, 1200)
    first = packing.best_fit(lengths, 2048)
    got = packing.improve([list(b) for b in first], lengths, 2048)
    assert sorted(sum(got, [])) == list(range(1200)) and all(lengths[b].sum() <= 2048 for b in got)
    assert packing.least_bins(lengths, 2048) <= len(got) <= min(len(first), over * packing.least_bins(lengths, 2048))


def test_bound_of_bins():
    rng = np.random.default_rng(0)

    def fewest(sizes, room=()):  # all ways, by recursion
        if not sizes:
            return len(room)
        n, *rest = sizes
        return min([fewest(rest, (*room, 10 - n)), *(fewest(rest, (*room[:k], r - n, *room[k + 1 :])) for k, r in enumerate(room) if r >= n)])

    for _ in range(40):
        lengths = rng.integers(1, 11, 7)
        bound, got = packing.least_bins(lengths, 10), len(packing.improve(packing.best_fit(lengths, 10), lengths, 10))
        assert bound <= fewest(sorted(lengths.tolist(), reverse=True)) <= got <= bound + 1


def test_packing_equal_rows(spark, bpe):
    """Rows that are alike in everything are dealt over all groups."""
    rows = spark.createDataFrame([(None, "a b c", "clash")] * 300 + [(7, "a b c", "clash")] * 300, "doc_id long, text string, sequence_id string")
    got = packing.pack(rows, BYTE_BPE, capacity=64, group_rows=50).collect()
    n = len(bpe.encode("a b c", add_special_tokens=False).ids) + 1
    assert len(got) == 600 and len({(r["sequence_id"], r["offset"]) for r in got}) == 600
    assert len({r["sequence_id"] for r in got}) == -(-600 // (64 // n))
