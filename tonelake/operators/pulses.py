"""From frames to pulses, characters and words, as windows and groups over one recording each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CODES, literal_map
from .percentiles import percentiles

TONE_IS_DAH, GAP_ENDS_SIGN, GAP_ENDS_WORD = 2.0, 2.0, 5.0


def moving_mean(df: DataFrame, key: str, order: str, value: str, out: str = "smooth") -> DataFrame:
    """Mean of three neighbouring frames; at an edge the frame itself stands in for the missing one."""
    w = Window.partitionBy(key).orderBy(order)
    before, after = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
    return df.withColumn(out, (before + F.col(value) + after) / 3)


def binarize_frames(df: DataFrame, key: str, value: str, out: str = "is_on") -> DataFrame:
    """On where a frame is above the 10th percentile plus 35 % of the way to the 90th. Percentiles are exact and bounded in memory, then joined back."""
    bounds = percentiles(df, key, value, {"__low": 0.1, "__high": 0.9})
    joined = df.join(bounds, key)
    return joined.withColumn(out, F.col(value) > F.col("__low") + (F.col("__high") - F.col("__low")) * 0.35).drop("__low", "__high")


def frames_to_pulses(df: DataFrame, key: str, frame: str, is_on: str, frame_s: float) -> DataFrame:
    """Runs of equal frames: ``key, start_s, dur_s, is_tone``."""
    w = Window.partitionBy(key).orderBy(frame)
    flips = df.withColumn("__new", F.coalesce((F.col(is_on) != F.lag(is_on).over(w)).cast("int"), F.lit(1)))
    runs = flips.withColumn("__run", F.sum("__new").over(w))
    got = runs.groupBy(key, "__run").agg(F.min(frame).alias("__first"), F.count("*").alias("__n"), F.first(is_on).alias("is_tone"))
    return got.select(key, (F.col("__first") * frame_s).alias("start_s"), (F.col("__n") * frame_s).alias("dur_s"), "is_tone")


def estimate_dit(pulses: DataFrame, key: str, shortest_s: float = 0.01, default_s: float = 0.06) -> DataFrame:
    """Median of the tones near the short third of them; a default where a recording has none."""
    tones = pulses.where(F.col("is_tone") & (F.col("dur_s") >= shortest_s))
    short = percentiles(tones, key, "dur_s", {"__c": 0.33})
    dits = percentiles(tones.join(short, key).where(F.col("dur_s") <= 1.5 * F.col("__c")), key, "dur_s", {"dit_s": 0.5})
    return pulses.select(key).distinct().join(dits, key, "left").select(key, F.coalesce("dit_s", F.lit(default_s)).alias("dit_s"))


def decode_characters(pulses: DataFrame, dit: DataFrame | float, key: str) -> DataFrame:
    """Signs of pulses: ``key, word_id, char_id, char, pattern, start_s, end_s``.

    A sign is the tones between two gaps of 2 dits or more, a word those between gaps of 5 or more. A sign ends where the first gap
    that closes it begins; the last one, if no gap follows, one dit after its start. Unknown patterns read ``?``.
    """
    rows = pulses.withColumn("dit_s", F.lit(dit)) if isinstance(dit, float) else pulses.join(dit, key)
    ratio = F.when(F.col("dit_s") > 0, F.col("dur_s") / F.col("dit_s")).otherwise(1.0)
    w = Window.partitionBy(key).orderBy("start_s")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = (~F.col("is_tone") & (F.col("__r") >= GAP_ENDS_SIGN)).cast("int")
    breaks = (~F.col("is_tone") & (F.col("__r") >= GAP_ENDS_WORD)).cast("int")
    rows = rows.withColumn("__r", ratio).withColumn("char_id", F.coalesce(F.sum(ends).over(before), F.lit(0))).withColumn("word_id", F.coalesce(F.sum(breaks).over(before), F.lit(0)))
    mark = F.when(F.col("is_tone"), F.struct("start_s", F.when(F.col("__r") < TONE_IS_DAH, ".").otherwise("-").alias("m")))
    signs = rows.groupBy(key, "char_id").agg(
        F.min("word_id").alias("word_id"),
        F.array_join(F.transform(F.sort_array(F.collect_list(mark)), lambda x: x["m"]), "").alias("pattern"),
        F.min(F.when(F.col("is_tone"), F.col("start_s"))).alias("start_s"),
        F.min(F.when(~F.col("is_tone") & (F.col("__r") >= GAP_ENDS_SIGN), F.col("start_s"))).alias("__closed"),
        F.first("dit_s").alias("__dit"),
    )
    table = literal_map({v: k for k, v in CODES.items()})
    char = F.coalesce(table[F.col("pattern")], F.lit("?"))
    return signs.where(F.col("pattern") != "").select(key, "word_id", "char_id", char.alias("char"), "pattern", "start_s", F.coalesce("__closed", F.col("start_s") + F.col("__dit")).alias("end_s"))


def decode_words(pulses: DataFrame, dit: DataFrame | float, key: str) -> DataFrame:
    """Words of pulses: ``key, word_id, word, start_s, end_s, chars``."""
    signs = decode_characters(pulses, dit, key)
    item = F.struct("char_id", "char", "pattern", "start_s", "end_s")
    got = signs.groupBy(key, "word_id").agg(F.sort_array(F.collect_list(item)).alias("chars"), F.min("start_s").alias("start_s"))
    return got.select(key, "word_id", F.array_join(F.transform("chars", lambda c: c["char"]), "").alias("word"), "start_s", F.element_at("chars", -1)["end_s"].alias("end_s"), "chars")


def rolling_speed(tones: DataFrame, key: str, order: str, dur: str, low_s: float, high_s: float, default_two_dits: float, keep: int = 10) -> DataFrame:
    """Speed from the last ``keep`` accepted pairs of neighbouring tones of which one is more than twice the other.

    The queue starts full of the default; each accepted pair adds its mean.
    """
    w = Window.partitionBy(key).orderBy(order)
    pair = tones.withColumn("__prev", F.lag(dur).over(w))
    inside = lambda c: (c >= low_s) & (c <= high_s)
    good = ((F.col(dur) > 2 * F.col("__prev")) | (F.col("__prev") > 2 * F.col(dur))) & inside(F.col(dur)) & inside(F.col("__prev"))
    rows = pair.where(good).withColumn("__mean", (F.col(dur) + F.col("__prev")) / 2)
    last = Window.partitionBy(key).orderBy(order).rowsBetween(-(keep - 1), 0)
    n, total = F.count("__mean").over(last), F.sum("__mean").over(last)
    two = (total + (keep - n) * default_two_dits) / keep
    return rows.select(key, order, two.alias("two_dits_s"), (2.4 / two).alias("wpm"))


def carried(df: DataFrame, key: str, order: str, value: str) -> tuple[Column, Column]:
    """The nearest known value before and after a row."""
    w = Window.partitionBy(key).orderBy(order)
    return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
