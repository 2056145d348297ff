"""A training corpus from raw documents: language, quality, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes what each stage returns to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm import language_id, near_copies, packing, pu_quality, secret_scan
from tonelake.llm.common import fold, stored
from tonelake.llm.queries import BYTE_BPE, PIECE_MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text goes if no language explains it better than all others together.
LANGUAGE_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay; a missing ``lang`` is filled in. Texts without letters (null and empty ones too) and undecided ones go.

    Very long texts are read whole; ids and other columns may be null; repeated rows share one fate. Columns beside those of ``documents``
    are dropped here, so their names cannot clash later. An empty table stays empty.
    """
    found = language_id.identify(docs, docs, PIECE_MODEL, COLUMNS)
    good = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE))
    return good.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier predicts as good stay. It learns from the labels of two folds of three.

    Null and empty texts are judged like any other, very long ones are read whole; a score of exactly one half stays. Without labels to
    learn from all stay. Repeated rows share one fate; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = fold("doc_id", 3) != 1
    trusted = labels.where((F.col("quality") == 1) & learn).select("doc_id")
    found = pu_quality.classify(docs, docs.where(learn), trusted, COLUMNS)
    return found.where("predicted = 1").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by 80 % of their five-word shingles, the one with the smallest id stays.

    Texts without words are no copies of each other and stay. Rows without an id stay. Repeated rows (one id, one text) become one row, with
    the smallest of their other columns; different texts under one id are judged each for itself, and of linked ones under one id one stays.
    Very long texts are read whole; an empty table stays empty.
    """
    marked = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    found = near_copies.near_copies(marked, width=5, percent=80, keep=["text_hash"]).where("first and doc_id is not null")
    same = F.coalesce("class_id", F.concat(F.lit("text "), F.col("text_hash").cast("string")))  # one text of those with equal shingles
    kept = found.groupBy("doc_id", same.alias("same")).agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash")
    named = marked.join(kept, ["doc_id", "text_hash"], "left_semi")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = named.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", "rest.*")
    return one.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; what is found in its text is replaced by a mark, and ``n_chars`` follows.

    Null and empty texts stay as they are, very long ones are read whole; repeated rows stay repeated, an empty table empty.
    """
    found = secret_scan.scan(docs, keep=COLUMNS)
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("secret_spans")))
    return clean.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of all documents in sequences of at most 2048; a null or empty text is its end token, a very long one several pieces. Repeated rows are pieces of their own."""
    return packing.pack(docs, BYTE_BPE, capacity=2048)


STAGES = [("language ID", known_language), ("quality classifier", good_quality), ("near copies", one_of_each_group), ("secret scan", without_secrets), ("packing", packed)]

#: Trained models and tokenizers stand behind the first stages: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
