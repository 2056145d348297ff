"""Quality rules, with built-in expressions only: counts of each text, and a hashed n-gram likelihood ratio.

Two multinomials over hashed n-grams are counted: one from trusted documents, one from the whole corpus. An n-gram is one whole word
or two neighbouring ones. A document's score is the mean log-ratio of its n-grams, drawn to 0 by ``PRIOR`` n-grams of ratio 1 so that
a few words decide nothing. Its own n-grams are taken out of both multinomials first, so a trusted document is judged like one that nobody has seen.
One threshold for every document: the score below which a share ``LOSE`` of the trusted documents falls.

The model is a table of ``SINGLES`` + ``PAIRS`` rows at most on any corpus, so it is broadcast; a text's n-grams meet it row by row
and are summed before anything is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Hash buckets of words and of pairs: the model has this size on any corpus.
SINGLES, PAIRS = 1 << 15, 3 << 15
#: A bucket and its count in a text are one number: buckets are below this, counts are multiples of it.
ONCE = SINGLES + PAIRS  # a power of two
#: Occurrences at the corpus's own share that every bucket has beforehand: rare n-grams say little.
DRAW = 10.0
PRIOR = 20
LOSE = 0.01
#: Log-ratios are summed as whole numbers of these, so that no order of adding matters.
STEPS = 10_000
#: The white space between words beside the blank itself.
OTHER_SPACE = "\t\n\x0b\x0c\r"
#: Ids that may be broadcast (8 bytes each); above it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    """Runs of characters other than white space. Replacing and cutting at one character is far cheaper than cutting at a pattern."""
    for c in OTHER_SPACE:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def counted(docs: DataFrame, text: str, more: list[str] | None = None) -> DataFrame:
    """``doc_id``, the columns ``more``, ``hashes`` of the words, and the base counts."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    more = more or []
    rows = docs.select("doc_id", *more, body.alias("body"), words_of(body).alias("words")).withColumn("n", F.size("words")).withColumn("hashes", hashes_of(F.col("words")))
    windows = F.transform(F.slice("hashes", F.lit(1), F.greatest(F.col("n") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2)))
    rows = rows.withColumn("windows", windows)
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.filter(F.transform("placed", lambda x, k: F.when((x["h"] == F.get("placed", k - 1)["h"]) | (x["h"] == F.get("placed", k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(same, lambda i: F.array(i, i + 1, i + 2)))))
    lines = F.when(F.contains("body", F.lit("\n")), F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("lines", lines)
    return rows.select(
        "doc_id",
        *more,
        "hashes",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("placed").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def buckets(hashes: str, more: int = 0) -> Column:
    """Hash buckets of the words and of the pairs of neighbouring words, of a column of hashes, each plus ``more``."""
    # none is null, so that they are sorted as plain numbers
    singles = F.transform(hashes, lambda h: h.bitwiseAND(SINGLES - 1) + more)
    pairs = F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: F.coalesce(F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(PAIRS)), F.lit(0)) + (SINGLES + more))
    return F.concat(singles, pairs)


def tallied(rows: DataFrame) -> DataFrame:
    """``rows`` with ``tally``: each bucket of the column ``hashes`` plus ``ONCE`` times its count, and ``size``: all occurrences."""
    rows = rows.withColumn("own", F.sort_array(buckets("hashes", ONCE))).withColumn("size", F.size("own"))
    # what stands beside its like occurs again; only that has to be counted
    rows = rows.withColumn("again", F.filter("own", lambda b, i: F.get("own", i - 1) == b))
    cuts = F.filter(F.transform("again", lambda b, i: F.when((i == 0) | (F.get("again", i - 1) != b), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("cuts", cuts)
    more = F.transform("cuts", lambda at, k: F.get("again", at) + (F.coalesce(F.get("cuts", k + 1), F.size("again")) - at).cast("long") * ONCE)
    return rows.withColumn("tally", F.concat(F.array_except("own", "again"), more)).drop("own", "again", "cuts")


def bucket_counts(rows: DataFrame) -> DataFrame:
    """``bucket, n, good``: occurrences of every bucket seen, and those in trusted documents, of ``good, hashes``."""
    grams = rows.select("good", F.explode(buckets("hashes")).alias("bucket"))
    return stored(grams.groupBy("bucket").agg(F.count("*").alias("n"), F.count(F.when(F.col("good"), 1)).alias("good")))  # SINGLES + PAIRS rows at most


def scored(rows: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``rid, good, hashes`` and ``score``: each document's own n-grams count in neither multinomial."""
    every, trusted = counts.agg(F.sum("n"), F.sum("good")).first()
    grams = tallied(rows).select("rid", "good", "size", *keep, F.explode_outer("tally").alias("x"))
    grams = grams.withColumn("bucket", F.col("x").bitwiseAND(ONCE - 1)).withColumn("c", F.shiftright("x", ONCE.bit_length() - 1)).drop("x")
    met = grams.join(F.broadcast(counts.withColumnRenamed("good", "g")), "bucket", "left")
    mine = F.col("good").cast("int")
    share = F.greatest(F.lit(trusted or 0) - mine * F.col("size"), F.lit(1)) / F.greatest(F.lit(every or 0) - F.col("size"), F.lit(1))
    ratio = F.log((F.col("g") - mine * F.col("c") + DRAW * share) / (F.col("n") - F.col("c") + DRAW) / share)
    steps = F.sum(F.rint(ratio * STEPS).cast("long") * F.col("c"))
    # rows of a text stand together, so one row a text is shuffled
    whole = met.groupBy("rid").agg(*[F.first(c).alias(c) for c in ("good", "size", *keep)], steps.alias("steps"))
    return whole.select("good", *keep, (F.coalesce("steps", F.lit(0)) / STEPS / (F.col("size") + PRIOR)).alias("score"))


def judge(docs: DataFrame, trusted: DataFrame, lose: float = LOSE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the base counts, ``base_failed``, ``score`` and ``kept``.

    ``trusted`` has the ids of trusted documents; those that pass the base set the threshold, which ``lose`` of them miss. Without any, every score is 0 and
    nothing is dropped for it. A score at the threshold is kept. Null and empty texts have no words and fail the base. Very long texts are read whole; a task
    holds the words of one at a time. Null ids are never trusted; ties and repeated rows are rows like any other; other columns are not carried, so their
    names cannot clash. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    failed = ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed")
    ids = trusted.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    some = ids.count()
    if not some:
        return counted(rows, "text").select("doc_id", *BASE, failed, F.lit(0.0).alias("score")).withColumn("kept", ~F.col("base_failed"))
    side = ids.withColumn("__good", F.lit(True))
    rows = rows.join(F.broadcast(side) if some <= BROADCAST_ROWS else side, "doc_id", "left").withColumn("good", F.coalesce("__good", F.lit(False)))
    counts = bucket_counts(rows.select("good", hashes_of(words_of(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("hashes")))
    found = counted(rows, "text", ["good"]).withColumn("rid", F.monotonically_increasing_id())
    found = stored(scored(found, counts, ["doc_id", *BASE]).select("good", "doc_id", *BASE, failed, "score"))
    bar = found.where("good and not base_failed").agg(F.percentile(F.floor(F.col("score") * 1000), F.lit(lose))).first()[0]  # few distinct values on any corpus
    bar = F.lit(-math.inf if bar is None else bar / 1000)
    return found.select("doc_id", *BASE, "base_failed", "score").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= bar))
