"""Every registered query of the subpackage on the smallest tables: columns, one row for each input row, and values by plain Python."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from tests.llm.test_copies import component_of, shingles
from tests.llm.test_models import ASSIGN, rule_counts
from tonelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name, types, key="doc_id"):
    df = QUERIES[name](spark, SF)
    assert dict(df.dtypes) | types == dict(df.dtypes)
    rows = df.collect()
    return {r[key]: r for r in rows} if name != "op7_packing" else rows


def test_sentencepiece(spark, texts):
    got = rows_of(spark, "op1_sentencepiece", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, t in texts.items():
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert got[i][1:4] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert set(got) == set(texts)


def test_language_model(spark, texts):
    got = rows_of(spark, "op2_context_tree_lm", {"held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"})
    assert set(got) == set(texts) and all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in got.values())


@pytest.mark.parametrize("name,column", [("op3_quality_classifier", "predicted"), ("op6_language_id", "lang_pred")])
def test_classifiers(spark, texts, name, column):
    got = rows_of(spark, name, {"doc_id": "bigint", "held_out": "boolean", "score": "double", column: "int" if column == "predicted" else "string"})
    assert set(got) == set(texts) and all(0 <= r["score"] <= 1 for r in got.values())


def test_vectors(spark):
    got = rows_of(spark, "op4_vector_copies", {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}, "vec_id")
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, label = [r["vec_id"] for r in rows], np.array([r["label"] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    order = np.argsort(ids)
    first = component_of(len(ids), [(int(np.where(order == a)[0][0]), int(np.where(order == b)[0][0])) for a, b in zip(*np.nonzero(near), strict=True)])
    for k, at in enumerate(order):
        r = got[ids[at]]
        assert (r["n_links"], r["component_id"], r["kept"]) == (near[at].sum(), ids[order[first[k]]], first[k] == k)


def test_secrets(spark, texts):
    got = rows_of(spark, "op5_secret_spans", {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"})
    for i, t in texts.items():
        kinds = [[(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6], [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20], [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]]
        named = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(sum(kinds, []))]
        assert got[i][1:5] == (*map(len, kinds), hashlib.sha256(",".join(named).encode()).hexdigest())
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("random")] == named
    assert set(got) == set(texts)


def test_packing(spark, texts):
    from tests.llm.test_tokens import check_packing

    rows = rows_of(spark, "op7_packing", {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"})
    ids = sorted(texts)
    place = {i: k for k, i in enumerate(ids)}
    rows = [r.asDict() | {"doc_id": place[r["doc_id"]]} for r in rows]
    used, least = check_packing(rows, [texts[i] for i in ids], tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 2048)
    assert used <= least + 1


def test_token_counts(spark, texts):
    got = rows_of(spark, "op8_token_counts", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"})
    bpe = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in texts.items():
        n = len(bpe.encode(t, add_special_tokens=False).ids)
        assert got[i][1:4] == (len(t.encode()), n, n > 512)


def test_near_copies(spark, texts):
    got = rows_of(spark, "op9_minhash_near_copies", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"})
    ids = sorted(texts)
    sets = [shingles(texts[i], 4) for i in ids]
    first = component_of(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    for k, i in enumerate(ids):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[k]), ids[first[k]], first[k] == k)


def test_rules(spark, texts):
    got = rows_of(spark, "op10_quality_rules", {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"})
    for i, t in texts.items():
        assert got[i][1:6] == rule_counts(t)


def test_very_long_texts_without_spaces(spark):
    """Prefix counts, pieces and codec on one long run of letters, against the libraries."""
    from tests.llm.test_tokens import BYTE_BPE, PIECE_MODEL
    from tonelake.llm import piece_codec, prefix_counts

    rng = np.random.default_rng(1)
    rows = [(1, "".join(rng.choice(list(LONG), 60_000))), (2, "é" * 20_000), (3, " ".join("".join(rng.choice(list("etaoin"), 6)) for _ in range(30_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bpe = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = {r["doc_id"]: r["n_tokens"] for r in prefix_counts.budget_counts(docs, *BYTE_BPE, budget=512).collect()}
    assert counts == {i: len(bpe.encode(t, add_special_tokens=False).ids) for i, t in rows}
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    got = {r["doc_id"]: r for r in piece_codec.encode_decode(docs, PIECE_MODEL).collect()}
    for i, t in rows:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert got[i]["ids"] == ids and got[i]["decoded"] == sp.decode(ids)
