"""Sources, holdouts, folds, leak-free training sets and mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.io import stored
from .quality import hash_order

#: Keys that may be broadcast; above it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000


def sources(chunks: DataFrame, source: str, bucket: str) -> DataFrame:
    return chunks.groupBy(source, bucket).agg(F.count("*").alias("n"))


def pick_evenly(sources: DataFrame, bucket: str, order: str, k: int) -> DataFrame:
    """``k`` evenly spaced sources of each bucket's sorted list; all of them where there are no more, the middle one for 1."""
    by = Window.partitionBy(bucket)
    rows = sources.withColumn("__i", F.row_number().over(by.orderBy(order)) - 1).withColumn("__n", F.count("*").over(by))
    if k == 1:
        keep = F.col("__i") == F.floor(F.col("__n") / 2)
    else:
        places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("__n") - 1) / (k - 1)).cast("int"))
        keep = F.array_contains(places, F.col("__i"))
    return rows.where((F.col("__n") <= k) | keep).drop("__i", "__n")


def holdout_sources(sources: DataFrame, source: str, bucket: str, order: list[str], target: int = 50) -> DataFrame:
    """Whole sources until ``target`` chunks are held out: one from each bucket in turn, each time the one whose size is nearest to what
    is missing (then the smaller, then the first by key); then from all.

    Each choice depends on the one before, but all come from a small index: of each bucket and size up to the target the first ``target`` keys, and of larger sizes the
    ``target`` smallest sources. One job gathers it, whatever the number of sources; the steps run on its rows, buckets x target x (target + 1) at most.
    """
    first = Window.partitionBy(bucket, F.least("n", F.lit(target + 1))).orderBy("n", source)
    index = sources.select(source, bucket, "n").withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= target).drop("__r")
    pool, chosen, total = [tuple(r) for r in index.collect()], [], 0

    def take(some: list[tuple]) -> bool:
        nonlocal total
        left = max(1, target - total)
        best = min(some, key=lambda x: (abs(x[2] - left), x[2], x[0]), default=None)
        if best is not None:
            pool.remove(best)
            chosen.append(best)
            total += best[2]
        return best is not None

    for b in order:
        if total >= target and len(chosen) >= 2:
            break
        take([x for x in pool if x[1] == b])
    while total < target and take(pool):
        pass
    return sources.sparkSession.createDataFrame(chosen, index.schema)


def assign_folds(sources: DataFrame, source: str, bucket: str, buckets: list[str], folds: int = 5) -> DataFrame:
    """Each bucket gives one source to each fold: the i-th largest goes to the i-th lightest so far. Sources beyond ``folds`` in a bucket must be picked before."""
    spark: SparkSession = sources.sparkSession
    load = spark.range(folds).select(F.concat(F.lit("fold_"), (F.col("id") + 1).cast("string")).alias("fold"), F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("n_sources"))
    out = None
    for b in buckets:
        ranked = sources.where(F.col(bucket) == b).withColumn("__r", F.row_number().over(Window.orderBy(F.desc("n"), source)))
        light = load.withColumn("__r", F.row_number().over(Window.orderBy("chunks", "n_sources", "fold")))
        pairs = light.join(ranked.select("__r", source, bucket, "n"), "__r", "left")
        got = pairs.where(F.col(source).isNotNull()).select("fold", source, bucket, "n")
        load = pairs.select("fold", (F.col("chunks") + F.coalesce("n", F.lit(0))).alias("chunks"), (F.col("n_sources") + F.col(source).isNotNull().cast("long")).alias("n_sources"))
        out = got if out is None else out.unionByName(got)
    return out


def exclusions(*parts: DataFrame) -> DataFrame:
    """Union of key sets (``kind, key``) from several manifests."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", "key").where(F.col("key").isNotNull()).distinct()


def training_set(chunks: DataFrame, excluded: DataFrame, chunk: str, source: str, wpm: str | None = None, min_wpm: float = 0.0) -> DataFrame:
    """Chunks neither excluded by file nor by source (two anti-joins), and fast enough; a missing speed is 0."""
    out = chunks
    for kind, key in (("file", chunk), ("source", source)):
        keys = excluded.where(F.col("kind") == kind).select(F.col("key").alias(key))
        if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            keys = F.broadcast(keys)
        out = out.join(keys, key, "left_anti")
    return out.where(F.coalesce(F.col(wpm), F.lit(0.0)) >= min_wpm) if wpm and min_wpm > 0 else out


def skip_counts(chunks: DataFrame, excluded: DataFrame, chunk: str, source: str, wpm: str, min_wpm: float) -> DataFrame:
    """One row: how many chunks a training set leaves out as held-out files, as held-out sources, as too slow, and how many it keeps."""
    rows = chunks.select(chunk, source, wpm)
    for kind, key in (("file", chunk), ("source", source)):
        keys = excluded.where(F.col("kind") == kind).select(F.col("key").alias(key), F.lit(True).alias(f"__{kind}"))
        if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            keys = F.broadcast(keys)
        rows = rows.join(keys, key, "left")
    file, held = F.col("__file").isNotNull(), F.col("__file").isNotNull() | F.col("__source").isNotNull()
    slow = ~held & (F.coalesce(F.col(wpm), F.lit(0.0)) < min_wpm)
    return rows.agg(F.count_if(file).alias("held_files"), F.count_if(held & ~file).alias("held_sources"), F.count_if(slow).alias("low_speed"), F.count_if(~held & ~slow).alias("kept"))


def usable(chunks: DataFrame, name: str, n_samples: str) -> DataFrame:
    """Chunks with sound, without those whose name says that they are tests."""
    return chunks.where((F.col(n_samples) > 0) & ~F.col(name).rlike("^test_"))


def drawn(seed: int, what: str, key: str, share: float) -> Column:
    """Whether a row is in a share of all, by a hash of seed, purpose and key: the same on every engine and partitioning."""
    bar = f"{int(share * (1 << 32)):09x}"  # nine digits, so that a share of 1 takes all
    return F.concat(F.lit("0"), F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), F.col(key).cast("string"))), 1, 8)) < bar


def leaks(train: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; must be empty."""
    return train.select(key).intersect(held.select(key))


def numbered(df: DataFrame, order: list[Column | str], into: str = "i", parts: int = 64) -> DataFrame:
    """Row numbers from 0 in a global order without a single task: sort by range, count each range, add the counts before it."""
    placed = stored(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))  # bounds come from a sample: drawn once
    own = placed.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return own.join(F.broadcast(before), "__p").withColumn(into, F.col("__before") + F.col("__k") - 1).drop("__p", "__k", "__before")  # at most ``parts`` rows are broadcast


def mix(pools: dict[str, DataFrame], ratios: dict[str, float], key: str, total: int, fallback: str, seed: int = 0) -> DataFrame:
    """``total`` rows from pools by ratio, small pools repeated in turn; an empty pool's share goes to ``fallback``. Keys only, in hash order."""
    counts = {name: df.count() for name, df in pools.items()}
    sizes, names = {}, list(ratios)
    for name in names[:-1]:
        sizes[name] = int(total * ratios[name])
    sizes[names[-1]] = total - sum(sizes.values())
    for name in names:
        if not counts[name] and name != fallback:
            sizes[fallback] += sizes.pop(name)
    out = None
    for name, size in sizes.items():
        if not size or not counts[name]:
            continue
        pool = numbered(pools[name].select(F.col(key).cast("string").alias("item")), ["item"])
        slots = pools[name].sparkSession.range(size).select(F.col("id").alias("slot"), (F.col("id") % counts[name]).alias("i"))
        part = slots.join(pool, "i").select(F.lit(name).alias("pool"), "slot", "item")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), "pool", "slot")))


def batches(df: DataFrame, order: list[str], labels: str, size: int = 16, cap: int = 2000, frames: str = "frames") -> DataFrame:
    """Batch number, widest input (capped) and padded shapes; labels of a batch are joined in order."""
    rows = numbered(df, order, "__i").withColumn("batch", F.floor(F.col("__i") / size)).withColumn("__f", F.least(F.col(frames), F.lit(cap)))
    item = F.struct("__i", "__f", labels)
    got = rows.groupBy("batch").agg(F.sort_array(F.collect_list(item)).alias("x"), F.max("__f").alias("width"))
    return got.select("batch", "width", F.transform("x", lambda r: r["__f"]).alias("lengths"), F.transform("x", lambda r: F.size(r[labels])).alias("label_lengths"), F.flatten(F.transform("x", lambda r: r[labels])).alias("labels"))


def held_out(rows: DataFrame, key: str, k: int = 10, seed: int = 0) -> DataFrame:
    """``k`` rows in hash order."""
    return rows.orderBy(hash_order(seed, key), key).limit(k)


def synthetic_sentences(spark: SparkSession, n: int, pool: list[str], seed: int = 0, min_words: int = 2, max_words: int = 5) -> DataFrame:
    """Sentences of pool words, call signs (1 in 10) and numbers (1 in 20), with a speed of 5 to 40; slow ones are short."""
    draw = lambda *salt: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), *salt), F.lit(1 << 20)) / float(1 << 20)
    rows = spark.range(n).withColumn("wpm", 5 + 35 * draw(F.lit("wpm")))
    low, high = F.when(F.col("wpm") < 10, 1).otherwise(min_words), F.when(F.col("wpm") < 10, 3).otherwise(max_words)
    count = (low + F.floor(draw(F.lit("n")) * (high - low + 1))).cast("int")
    words = F.array(*map(F.lit, pool))
    letters, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda i, salt, text: F.substring(F.lit(text), (F.floor(draw(F.lit(salt), i) * len(text)) + 1).cast("int"), F.lit(1))
    call = lambda i: F.concat(*[pick(i, f"c{k}", t) for k, t in enumerate((letters, digits, letters, letters))])
    number = lambda i: F.concat(*[pick(i, f"d{k}", digits) for k in range(3)])
    word = lambda i: F.when(draw(F.lit("kind"), i) < 0.10, call(i)).when(draw(F.lit("kind"), i) < 0.15, number(i)).otherwise(F.get(words, F.floor(draw(F.lit("w"), i) * len(pool)).cast("int")))
    return rows.withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), count), word), " "))
