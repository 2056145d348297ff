"""Cutting recordings into labelled chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CHUNK_SECONDS, MIN_WORDS_ALIGNED, MIN_WORDS_DURATION, MIN_WPM_EPISODE, MIN_WPM_SEQUENTIAL, PSEUDO_CHUNK_SECONDS, TARGET_WPM
from ..functions.text import character_speed, clean_vocab, slice_by_chars, slice_by_fraction, word_spans, words
from ..sources.io import stored

TIMED = "array<struct<word:string,start_s:double,end_s:double>>"


def pending(inputs: DataFrame, outputs: DataFrame, key: str, force: bool = False) -> DataFrame:
    """What has no output yet; everything with ``force`` (write it with dynamic partition overwrite)."""
    return inputs if force else inputs.join(outputs.select(key).distinct(), key, "left_anti")


def words_in_window(all_words: Column, start_s: Column, end_s: Column, per_second: Column) -> Column:
    """Words whose numbers lie between two times at a steady rate (half-even rounding, cut at the end)."""
    n = F.size(all_words)
    a, b = (F.least(F.rint(t * per_second).cast("int"), n) for t in (start_s, end_s))
    return F.slice(all_words, a + 1, F.greatest(b - a, F.lit(0)))


def label_by_duration(episodes: DataFrame, key: str, text: str, seconds: str, min_wpm: float = MIN_WPM_EPISODE, min_words: int = MIN_WORDS_DURATION, chunk_s: float = CHUNK_SECONDS) -> DataFrame:
    """Chunks of fixed length with the words that a steady rate puts there; too slow or short episodes give none."""
    rows = episodes.select(key, words(clean_vocab(F.col(text))).alias("__w"), F.col(seconds).alias("__d"))
    rows = rows.where((F.size("__w") >= min_words) & (F.col("__d") >= 1)).withColumn("__rate", F.size("__w") / F.col("__d")).where(F.col("__rate") * 60 >= min_wpm)
    at = F.posexplode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("__d") / chunk_s).cast("int") - 1, F.lit(0)))).alias("__i", "__k")
    rows = rows.select(key, "__w", "__d", "__rate", at)
    start = F.col("__k") * chunk_s
    end = F.least(start + chunk_s, F.col("__d"))
    got = rows.withColumn("start_s", start).withColumn("end_s", end).withColumn("__text", words_in_window(F.col("__w"), F.col("start_s"), F.col("end_s"), F.col("__rate"))).where(F.size("__text") >= min_words)
    index = F.row_number().over(Window.partitionBy(key).orderBy("start_s")) - 1
    return got.select(key, index.alias("chunk_idx"), F.array_join("__text", " ").alias("text"), F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), F.round(F.col("__rate") * 60, 1).alias("wpm"))


def segment_offsets(segments: DataFrame, key: str, order: str, seconds: str) -> DataFrame:
    """Where each segment begins and ends on its dataset's time line."""
    w = Window.partitionBy(key).orderBy(order)
    start = F.coalesce(F.sum(seconds).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return segments.withColumn("seg_start_s", start).withColumn("seg_end_s", start + F.col(seconds))


def label_sequential(segments: DataFrame, texts: DataFrame, key: str, order: str, seconds: str, text: str, min_wpm: float = MIN_WPM_SEQUENTIAL, min_words: int = MIN_WORDS_DURATION, chunk_s: float = CHUNK_SECONDS) -> DataFrame:
    """Chunks of datasets that are many segments with one text: ``key, chunk_idx, text, start_s, end_s, wpm, pieces``.

    The dataset's rate is its words over the sum of its segments; one that is slower than ``min_wpm`` gives nothing. Words are dealt at that rate over
    the whole time line, and ``pieces`` names the parts of segments whose sound a chunk is joined from, in order.
    """
    line = segment_offsets(segments, key, order, seconds)
    total = line.groupBy(key).agg(F.max("seg_end_s").alias("__total"))
    chunks = label_by_duration(texts.join(total, key), key, text, "__total", min_wpm, min_words, chunk_s)
    both = overlapping(chunks, line.select(key, order, "seg_start_s", "seg_end_s"), key, chunk_s)
    start, end = F.greatest("seg_start_s", "start_s"), F.least("seg_end_s", "end_s")
    piece = F.struct(F.col("seg_start_s"), F.col(order).alias("segment"), (start - F.col("seg_start_s")).alias("from_s"), (end - F.col("seg_start_s")).alias("to_s"))
    got = both.groupBy(key, "chunk_idx").agg(F.first("text").alias("text"), F.first("start_s").alias("start_s"), F.first("end_s").alias("end_s"), F.first("wpm").alias("wpm"), F.sort_array(F.collect_list(piece)).alias("__p"))
    return got.withColumn("pieces", F.transform("__p", lambda p: F.struct(p["segment"].alias("segment"), p["from_s"].alias("from_s"), p["to_s"].alias("to_s")))).drop("__p")


def _level(a: str, b: str, base_s: float) -> Column:
    """The least power of two of the base width that is as long as a span; such widths cut a span once at most."""
    return F.ceil(F.log2(F.greatest(F.col(b) - F.col(a), F.lit(base_s)) / base_s) - 1e-9).cast("int")


def placed(spans: DataFrame, a: str, b: str, others: list[int], base_s: float) -> DataFrame:
    """``spans`` in the cells of their own width and of each wider one that the other side has: ``__own``, ``__level``, ``__cell``. Two or three rows a width."""
    rows = spans.withColumn("__own", _level(a, b, base_s))
    levels = F.array_union(F.array("__own"), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col("__own")))
    rows = rows.withColumn("__level", F.explode(levels)).withColumn("__width", base_s * F.pow(F.lit(2.0), F.col("__level")))
    return rows.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(a) / F.col("__width")).cast("long"), F.floor(F.col(b) / F.col("__width")).cast("long"))))


def overlapping(chunks: DataFrame, segments: DataFrame, key: str, bucket_s: float = CHUNK_SECONDS) -> DataFrame:
    """Chunks with the segments that they overlap: an equi-join on cells of dyadic widths, then the exact test. Each pair comes once.

    A pair meets in the cells of the longer span's width, which the shorter one touches two of at most; so a span of ten hours is a few rows, not one for
    every chunk that it could meet. The widths of either side (a few dozen numbers at most) are looked up first.
    """
    widths = lambda df, a, b: sorted(r[0] for r in df.select(_level(a, b, bucket_s)).distinct().collect() if r[0] is not None)
    left = placed(chunks, "start_s", "end_s", widths(segments, "seg_start_s", "seg_end_s"), bucket_s).withColumnRenamed("__own", "__mine")
    right = placed(segments, "seg_start_s", "seg_end_s", widths(chunks, "start_s", "end_s"), bucket_s).drop("__width")
    both = left.join(right, [key, "__level", "__cell"]).where(F.col("__level") == F.greatest("__mine", "__own"))
    first = F.floor(F.greatest("start_s", "seg_start_s") / F.col("__width")).cast("long")
    return both.where((F.col("seg_end_s") > F.col("start_s")) & (F.col("seg_start_s") < F.col("end_s")) & (F.col("__cell") == first)).drop("__level", "__cell", "__width", "__mine", "__own")


def proportional_chunks(recordings: DataFrame, key: str, text: str, seconds: str, chunk_s: float = CHUNK_SECONDS) -> DataFrame:
    """Equal shares of a recording, each with the words that its share of the time covers.

    A recording's words are placed once; each goes to the one or two shares that it touches, so the work grows with words plus
    shares. Only shares that no word touches (a gap longer than a share) look at the whole recording for the nearest one.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col(seconds) / chunk_s).cast("int"))
    rows = recordings.select(key, F.col(text).alias("__text"), n.alias("__n"), word_spans(F.col(text)).alias("__spans")).withColumn("__total", F.try_element_at("__spans", F.lit(-1))["end_u"])
    shares = rows.select(key, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("chunk_idx"), "__n").select(key, "chunk_idx", (F.col("chunk_idx") / F.col("__n")).alias("frac_s"), ((F.col("chunk_idx") + 1) / F.col("__n")).alias("frac_e"))
    placed = rows.select(key, "__n", "__total", F.posexplode("__spans").alias("__i", "__w")).select(key, "__n", "__total", "__i", "__w.*")
    near = lambda c, d: F.greatest(F.lit(0), F.least(F.col("__n") - 1, F.floor(F.col(c) / F.col("__total") * F.col("__n")).cast("int") + d))
    placed = placed.withColumn("chunk_idx", F.explode(F.sequence(near("start_u", -1), near("end_u", 1))))
    fs, fe = F.col("chunk_idx") / F.col("__n"), (F.col("chunk_idx") + 1) / F.col("__n")
    placed = placed.withColumn("__a", fs * F.col("__total")).withColumn("__b", fe * F.col("__total")).where((F.col("end_u") > F.col("__a")) & (F.col("start_u") < F.col("__b")))
    margin = F.least((F.col("__b") - F.col("__a")) * 0.15, F.col("__total") * 0.05)
    low = F.when(fs <= 0.02, F.col("__a")).otherwise(F.least(F.col("__b"), F.col("__a") + margin))
    high = F.when(fe >= 0.98, F.col("__b")).otherwise(F.greatest(F.col("__a"), F.col("__b") - margin))
    middle = (F.col("start_u") + F.col("end_u")) / 2
    core = F.when((middle >= low) & (middle <= high), F.struct("__i", "word"))
    joined = lambda c: F.upper(F.array_join(F.transform(F.sort_array(c), lambda x: x["word"]), " "))
    got = placed.groupBy(key, "chunk_idx").agg(F.collect_list(core).alias("__core"), F.collect_list(F.struct("__i", "word")).alias("__all"))
    got = got.select(key, "chunk_idx", F.when(F.size("__core") > 0, joined(F.col("__core"))).otherwise(joined(F.col("__all"))).alias("__got"))
    every = shares.join(got, [key, "chunk_idx"], "left")
    empty = every.where("__got is null").drop("__got").join(rows.select(key, "__text"), key)
    rest = empty.select(key, "chunk_idx", "frac_s", "frac_e", slice_by_fraction(F.col("__text"), F.col("frac_s"), F.col("frac_e")).alias("text"))
    return every.where("__got is not null").select(key, "chunk_idx", "frac_s", "frac_e", F.col("__got").alias("text")).unionByName(rest)


def label_pseudo(decoded: DataFrame, key: str, text: str, seconds: str, chunk_s: float = PSEUDO_CHUNK_SECONDS) -> DataFrame:
    """Pieces of a decoded text by time; empty ones go."""
    n = F.greatest(F.lit(1), F.ceil(F.col(seconds) / chunk_s).cast("int"))
    rows = decoded.withColumn("__n", n).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    fs = F.col("chunk_idx") * chunk_s / F.col(seconds)
    fe = F.least(F.lit(1.0), (F.col("chunk_idx") + 1) * chunk_s / F.col(seconds))
    piece = F.when(F.col("__n") == 1, F.trim(text)).otherwise(slice_by_chars(F.col(text), fs, fe))
    return rows.select(key, "chunk_idx", F.upper(piece).alias("text")).where(F.col("text") != "")


def random_windows(recordings: DataFrame, key: str, text: str, n_samples: str, seed: int, epoch: int, window: int = 64_000) -> DataFrame:
    """One window of each recording, its start drawn by a hash of seed, epoch and id; short recordings are taken whole."""
    room = F.greatest(F.col(n_samples) - window, F.lit(0))
    start = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), room + 1)
    fs, fe = start / F.col(n_samples), F.least(F.lit(1.0), (start + window) / F.col(n_samples))
    cut = F.when(F.col(n_samples) > window, slice_by_fraction(F.col(text), fs, fe)).otherwise(F.upper(F.trim(text)))
    return recordings.select(key, start.alias("start"), cut.alias("text"))


def _hits(decoded: Column, truth: Column) -> Column:
    """For each transcript word the number of its decoded word, or -1: one fold whose state is where to look next.

    A word looks at two decoded words before that place and five from it on, takes the least edit distance (the first of equal ones), and moves the place behind
    the one it looked at best, even if that was too far off to count.
    """
    heard = F.transform(decoded, lambda d: F.btrim(d["word"], F.lit("=<>?")))
    n = F.size(decoded)

    def step(acc: Column, word: Column) -> Column:
        low = F.greatest(F.lit(0), acc["at"] - 2)
        near = F.slice(heard, low + 1, F.greatest(F.lit(0), F.least(n, acc["at"] + 5) - low))
        best = F.array_min(F.transform(near, lambda h, i: F.struct(F.levenshtein(word, h).alias("d"), (low + i).alias("k"))))
        hit = F.when(best["d"] <= F.greatest(F.lit(2), F.floor(F.length(word) / 2).cast("int")), best["k"]).otherwise(-1)
        return F.struct((F.coalesce(best["k"], low) + 1).alias("at"), F.concat(acc["hits"], F.array(F.coalesce(hit, F.lit(-1)))).alias("hits"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))
    return F.aggregate(truth, start, step, lambda acc: acc["hits"])


def fill_times(words: DataFrame, key: str, gap_s: float = 0.05) -> DataFrame:
    """Missing times of ``key, pos, word, start_s, end_s``: evenly between two known words, chained with a small gap before the first and after the last."""
    known = F.when(F.col("start_s").isNotNull(), F.struct("pos", "start_s", "end_s"))
    w = Window.partitionBy(key).orderBy("pos")
    rows = words.withColumn("__a", F.last(known, ignorenulls=True).over(w)).withColumn("__b", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    a, b, pos = F.col("__a"), F.col("__b"), F.col("pos")
    length = F.coalesce(a["end_s"] - a["start_s"], b["end_s"] - b["start_s"])
    between = a["end_s"] + (pos - a["pos"]) / (b["pos"] - a["pos"]) * (b["start_s"] - a["end_s"])
    before = b["start_s"] - (b["pos"] - pos) * (length + gap_s)
    after = a["end_s"] + gap_s + (pos - a["pos"] - 1) * (length + gap_s)
    start = F.coalesce("start_s", F.when(a.isNotNull() & b.isNotNull(), between).when(b.isNotNull(), before).when(a.isNotNull(), after))
    return rows.withColumn("end_s", F.coalesce("end_s", start + length)).withColumn("start_s", start).drop("__a", "__b")


def align_words(df: DataFrame, key: str, decoded: str, truth: str, fill: bool = True) -> DataFrame:
    """``key, aligned``: every transcript word with times; ``decoded`` is an array of words with times, ``truth`` an array of strings.

    Without decoded words all times are null; without transcript words ``aligned`` is empty. Nulls count as empty. Keys must be distinct.
    """
    rows = df.select(key, F.coalesce(F.col(decoded), F.array().cast(df.schema[decoded].dataType)).alias("__d"), F.coalesce(F.col(truth), F.array().cast("array<string>")).alias("__t"))
    hit = lambda k: F.when(k >= 0, F.get(F.col("__d"), k))
    rows = rows.withColumn("__h", _hits(F.col("__d"), F.col("__t")))
    aligned = F.transform("__h", lambda k, i: F.struct(F.get("__t", i).alias("word"), hit(k)["start_s"].alias("start_s"), hit(k)["end_s"].alias("end_s")))
    rows = rows.select(key, aligned.cast(TIMED).alias("aligned"))
    if not fill:
        return rows
    words_of = rows.select(key, F.posexplode_outer("aligned").alias("pos", "w")).select(key, "pos", "w.*")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "word", "start_s", "end_s"))
    got = fill_times(words_of, key).groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("x"))
    return got.select(key, F.transform("x", lambda x: F.struct(x["word"].alias("word"), x["start_s"].alias("start_s"), x["end_s"].alias("end_s"))).cast(TIMED).alias("aligned"))


def label_aligned(decoded: DataFrame, key: str, words_at: str, text: str, seconds: str, error: str | None = None, min_words: int = MIN_WORDS_ALIGNED, chunk_s: float = CHUNK_SECONDS) -> DataFrame:
    """The aligned labelling job: ``key, chunk_idx, text, n_words, start_s, end_s, error``.

    ``words_at``: decoded words with times. Transcript words take their times, missing ones are filled in, and chunks with ``min_words`` words stay
    under their number among all chunks. A recording that gives none is one row with what went wrong; nothing is passed over in silence.
    """
    truth = words(clean_vocab(F.col(text)))
    known = F.col(error) if error else F.lit(None).cast("string")
    wrong = F.coalesce(known, F.when(F.coalesce(F.size(truth), F.lit(0)) <= 0, "no text"), F.when(F.coalesce(F.size(words_at), F.lit(0)) <= 0, "nothing decoded"))
    rows = decoded.select(key, F.col(words_at).alias("__decoded"), truth.alias("__truth"), F.col(seconds).alias("__s"), wrong.alias("__wrong"))
    good = rows.where("__wrong is null")
    aligned = align_words(good, key, "__decoded", "__truth").join(good.select(key, "__s"), key)
    chunks = chunk_aligned(aligned, key, "aligned", "__s", chunk_s).where(F.col("n_words") >= min_words)
    short = good.select(key).join(chunks.select(key).distinct(), key, "left_anti").select(key, F.lit("too few words").alias("error"))
    failed = rows.where("__wrong is not null").select(key, F.col("__wrong").alias("error")).unionByName(short)
    return chunks.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def label_recordings(recordings: DataFrame, key: str, content: str, text: str, wpm: str, min_words: int = MIN_WORDS_ALIGNED, chunk_s: float = CHUNK_SECONDS) -> DataFrame:
    """The same from stored recordings: PCM or WAV bytes to sound, pulses and words at the declared speed of their signs."""
    from . import pulses, signal

    heard = signal.decode_pcm(recordings.select(key, content, text, wpm), content, "__audio", "__error")
    heard = stored(heard.withColumn("__seconds", signal.seconds(F.col("__audio"))).drop(content))
    flat = signal.to_pulses(heard.where(F.size("__audio") > 0), key, "__audio")
    heard = heard.drop("__audio")
    dit = heard.select(key, (1.2 / F.coalesce(character_speed(F.col(wpm)), F.lit(TARGET_WPM))).alias("dit_s"))
    got = pulses.decode_words(flat, dit, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_s", "end_s", "word"))).alias("__words"))
    silent = F.coalesce("__error", F.when(F.coalesce("__seconds", F.lit(0.0)) <= 0, "no sound"))
    return label_aligned(heard.join(got, key, "left").withColumn("__error", silent), key, "__words", text, "__seconds", "__error", min_words, chunk_s)


def chunk_aligned(df: DataFrame, key: str, aligned: str, seconds: str, chunk_s: float = CHUNK_SECONDS) -> DataFrame:
    """Chunks of timed words: a word that starts ``chunk_s`` or more after the chunk's first one opens the next.

    The walk is one fold over each recording's own array; ``chunk_idx`` counts all chunks, also those a later filter drops.
    """
    chunk = "struct<start_s:double,end_s:double,words:array<string>>"
    state = f"struct<start_s:double,end_s:double,words:array<string>,done:array<{chunk}>>"
    none = F.struct(F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"), F.array().cast("array<string>").alias("words"), F.array().cast(f"array<{chunk}>").alias("done")).cast(state)
    closed = lambda acc: F.struct(acc["start_s"].alias("start_s"), acc["end_s"].alias("end_s"), acc["words"].alias("words")).cast(chunk)

    def step(acc: Column, w: Column) -> Column:
        opened = F.coalesce(acc["start_s"], w["start_s"], F.lit(0.0))
        start = F.coalesce(w["start_s"], opened)
        new = (start - opened >= chunk_s) & (F.size(acc["words"]) > 0)
        return F.when(new, F.struct(start.alias("start_s"), w["end_s"].alias("end_s"), F.array(w["word"]).alias("words"), F.concat(acc["done"], F.array(closed(acc))).alias("done")).cast(state)).otherwise(
            F.struct(opened.alias("start_s"), w["end_s"].alias("end_s"), F.concat(acc["words"], F.array(w["word"])).alias("words"), acc["done"].alias("done")).cast(state)
        )

    all_chunks = F.aggregate(aligned, none, step, lambda acc: F.when(F.size(acc["words"]) > 0, F.concat(acc["done"], F.array(closed(acc)))).otherwise(acc["done"]))
    rows = df.select(key, F.col(seconds).alias("__d"), F.posexplode(all_chunks).alias("chunk_idx", "__c"))
    end = F.least(F.coalesce("__c.end_s", "__d") + 0.5, F.col("__d"))
    return rows.select(key, "chunk_idx", F.array_join("__c.words", " ").alias("text"), F.size("__c.words").alias("n_words"), F.round("__c.start_s", 3).alias("start_s"), F.round(end, 3).alias("end_s"))
