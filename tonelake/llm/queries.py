"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, context_tree, language_id, near_copies, packing, piece_codec, prefix_counts, pu_quality, quality_rules, secret_scan, spelling, url_filter, vector_copies
from .common import fold

#: Where the public vocabularies are; a parameter of every operator that reads one.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

#: The URL rules of the query, as its contract states them.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(_table(spark, sf_dir, "documents"), PIECE_MODEL, digests=True)


def op2_context_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = fold("doc_id", 5) == 1
    return context_tree.score(docs, docs.where(~held), held)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = fold("doc_id", 3) == 1
    trusted = _table(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~held)
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return pu_quality.classify(rows, docs.where(~held), trusted, ["doc_id", "held_out"])


def op4_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_copies.vector_copies(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("secret_spans", lambda x: x["k"] < 3)
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secret_scan.named(base), 256).alias("base_sha256"), secret_scan.named(F.col("secret_spans")).alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    return language_id.identify(docs.withColumn("held_out", held), docs.where(~held), PIECE_MODEL, ["doc_id", "held_out"])


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), BYTE_BPE, capacity=2048)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = prefix_counts.budget_counts(_table(spark, sf_dir, "documents"), *BYTE_BPE, budget=512)
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), F.col("within").alias("chars_within_limit"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.judge(_table(spark, sf_dir, "documents"), trusted)


def op9_minhash_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(_table(spark, sf_dir, "documents"), width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_context_tree_lm, op3_quality_classifier, op4_vector_copies, op5_secret_spans, op6_language_id, op7_packing, op8_token_counts, op9_minhash_near_copies, op10_quality_rules, op11_spelling_variants, op12_phrase_collocations, op13_url_filter)}
