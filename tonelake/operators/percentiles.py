"""Exact percentiles of the values of a key, in bounded memory whatever the number of values.

Keys with few values are sorted by Spark's own aggregate. For a key with many, every wanted rank has a span of values that holds it, first all. A pass counts the
values of each span in ``CELLS`` cells and keeps the cell of the rank, with its least and greatest value as the new span; so equal values end it, and
what is left is sorted once it is few. A pass brings one number to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored

#: Values of a key that are sorted at once, and cells of a pass.
FEW, CELLS = 50_000, 1024


def percentiles(df: DataFrame, key: str, value: str, wanted: dict[str, float], few: int = FEW) -> DataFrame:
    """``key`` and one column for each wanted share (0 to 1), linear between neighbours like ``percentile``.

    Nulls and NaN are left out; a key without other values has nulls. A null key is a key of its own. ``df`` is read once a pass: store it if it is dear.
    """
    x = F.col(value).cast("double")
    rows = df.select(F.struct(key).alias("key"), F.when(~F.isnan(x), x).alias("v"))
    sizes = stored(rows.groupBy("key").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    plain = [F.percentile("v", F.lit(q)).alias(name) for name, q in wanted.items()]
    if not sizes.where(F.col("n") > few).limit(1).count():
        return rows.groupBy("key").agg(*plain).select(f"key.{key}", *wanted)
    large = sizes.where(F.col("n") > few)
    small = rows.join(large.select("key"), "key", "left_anti").groupBy("key").agg(*plain)
    ranks = F.explode(F.array_distinct(F.concat(*[F.array(F.floor(place), F.ceil(place)) for place in (q * (F.col("n") - 1) for q in wanted.values())])))
    open_ = large.select("key", ranks.alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("many"))
    done = []
    while True:
        open_ = stored(open_)
        done.append(open_.where("lo = hi").select("key", "rank", F.col("lo").alias("v")))
        done.append(_sorted(rows, open_.where((F.col("lo") < F.col("hi")) & (F.col("many") <= few))))
        open_ = open_.where((F.col("lo") < F.col("hi")) & (F.col("many") > few))
        if not open_.count():
            break
        open_ = _narrowed(rows, open_)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two entries for each wanted share at most
    found = found.join(large.select("key", "n"), "key")
    place = {name: q * (F.col("n") - 1) for name, q in wanted.items()}
    at = lambda k: F.try_element_at("at", k)
    between = {name: F.when(F.floor(p) == F.ceil(p), at(F.floor(p))).otherwise((F.ceil(p) - p) * at(F.floor(p)) + (p - F.floor(p)) * at(F.ceil(p))) for name, p in place.items()}
    return small.unionByName(found.select("key", *[c.alias(name) for name, c in between.items()])).select(f"key.{key}", *wanted)


def _inside(rows: DataFrame, spans: DataFrame) -> DataFrame:
    return rows.join(spans, "key").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def _narrowed(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Each span cut down to the cell that holds its rank."""
    cell = F.least(F.lit(CELLS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * CELLS)).cast("int")  # halves do not overflow
    cells = _inside(rows, spans).groupBy("key", "rank", cell.alias("cell")).agg(F.count("*").alias("many"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("below").alias("start"))
    upto = F.sum("many").over(Window.partitionBy("key", "rank").orderBy("cell"))
    cells = cells.withColumn("below", F.col("start") + upto - F.col("many"))
    return cells.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("many"))).select("key", "rank", "lo", "hi", "below", "many")


def _sorted(rows: DataFrame, spans: DataFrame) -> DataFrame:
    got = _inside(rows, spans).groupBy("key", "rank").agg(F.sort_array(F.collect_list("v")).alias("x"), F.first("below").alias("below"))
    return got.select("key", "rank", F.get("x", (F.col("rank") - F.col("below")).cast("int")).alias("v"))
