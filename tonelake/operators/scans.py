"""Scans over the ordered rows of a key of which no task has to hold all: slices, their summaries, and what is carried into each.

Rows are dealt to ranges of (key, order), so a key may fill one range or all of them. Within a range a window does the work. A key that goes on over several
ranges has a small summary in each (a last value, a sum, a least value); these are scanned in turn, at most two for each range, and what they
carry over is broadcast to the rows of the range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored

SLICE = "__slice"
#: Ranges at most; the carried table has two rows a range.
MOST_PARTS = 4096


def sliced(df: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with the number of its range, written once: bounds come from a sample, which another run of the plan may draw otherwise."""
    parts = parts or min(MOST_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(df.repartitionByRange(parts, *key, *order).withColumn(SLICE, F.spark_partition_id()))


def _kinds(order: list[str], inside, ahead):
    """For each kind of scan: its value within a range, a range's summary, what is carried, and both together.

    ``inside``: window of a key's rows in one range; ``ahead``: of a key's summaries. Both are ordered.
    """
    at = F.struct(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    onward = inside.rowsBetween(0, Window.unboundedFollowing)
    past, future = ahead.rowsBetween(Window.unboundedPreceding, -1), ahead.rowsBetween(1, Window.unboundedFollowing)
    first, last = F.row_number().over(inside) == 1, F.lead(F.lit(1)).over(inside).isNull()
    known = lambda v: F.when(v.isNotNull(), F.struct(*order))
    return {
        "lag": (lambda v: F.struct(first.alias("end"), F.lag(v).over(inside).alias("v")), lambda v: F.max_by(v, at), lambda s: F.lag(s).over(ahead), lambda own, c: F.when(own["end"], c).otherwise(own["v"])),
        "lead": (lambda v: F.struct(last.alias("end"), F.lead(v).over(inside).alias("v")), lambda v: F.min_by(v, at), lambda s: F.lead(s).over(ahead), lambda own, c: F.when(own["end"], c).otherwise(own["v"])),
        "sum": (lambda v: F.sum(v).over(upto), F.sum, lambda s: F.sum(s).over(past), lambda own, c: F.when(c.isNull(), own).when(own.isNull(), c).otherwise(own + c)),
        "sum_before": (lambda v: F.sum(v).over(before), F.sum, lambda s: F.sum(s).over(past), lambda own, c: F.when(c.isNull(), own).when(own.isNull(), c).otherwise(own + c)),
        "min_before": (lambda v: F.min(v).over(before), F.min, lambda s: F.min(s).over(past), lambda own, c: F.least(own, c)),
        "last_known": (lambda v: F.last(v, ignorenulls=True).over(upto), lambda v: F.max_by(v, known(v)), lambda s: F.last(s, ignorenulls=True).over(past), F.coalesce),
        "next_known": (lambda v: F.first(v, ignorenulls=True).over(onward), lambda v: F.min_by(v, known(v)), lambda s: F.first(s, ignorenulls=True).over(future), F.coalesce),
    }


def scan(df: DataFrame, key: list[str] | str, order: list[str] | str, want: dict[str, tuple[str, Column]], parts: int | None = None, keep_slice: bool = False) -> DataFrame:
    """``df`` with new columns: name -> (kind, value), over the rows of a key in their order.

    Kinds: ``lag`` and ``lead`` (the value of the row before or after), ``sum`` (up to and with the row), ``sum_before`` and ``min_before`` (of all
    rows before it), ``last_known`` and ``next_known`` (the nearest value that is not null, its own counts). The order must be total within a key;
    equal rows stand in any order, but always in one range. Null keys are a key of their own. An empty table stays empty.
    """
    key, order = ([x] if isinstance(x, str) else list(x) for x in (key, order))
    rows = df if SLICE in df.columns else sliced(df, key, order, parts)
    kinds = _kinds(order, Window.partitionBy(SLICE, *key).orderBy(*order), Window.partitionBy(*key).orderBy(SLICE))
    longer = rows.groupBy(*key).agg(F.min(SLICE).alias("__lo"), F.max(SLICE).alias("__hi")).where("__lo < __hi").drop("__lo", "__hi")  # fewer than ranges
    same = lambda a, b, names: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{n}")) for k, n in names])
    going = rows.alias("r").join(F.broadcast(longer.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).alias("l")), same("r", "l", [(k, f"__k{i}") for i, k in enumerate(key)]), "left_semi")
    sums = going.groupBy(*key, SLICE).agg(*[kinds[kind][1](v).alias(name) for name, (kind, v) in want.items()])
    carried = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col(SLICE).alias("__s"), *[kinds[kind][2](F.col(name)).alias(f"__c_{name}") for name, (kind, _) in want.items()])
    own = rows.withColumns({f"__o_{name}": kinds[kind][0](v) for name, (kind, v) in want.items()})
    both = own.alias("o").join(F.broadcast(carried.alias("c")), same("o", "c", [(k, f"__k{i}") for i, k in enumerate(key)] + [(SLICE, "__s")]), "left")
    out = both.withColumns({name: kinds[kind][3](F.col(f"__o_{name}"), F.col(f"__c_{name}")) for name, (kind, _) in want.items()})
    drop = [c for c in out.columns if c.startswith(("__o_", "__c_", "__k")) or c == "__s"]
    return out.drop(*drop, *([] if keep_slice else [SLICE]))


def joined_text(rows: DataFrame, key: list[str] | str, order: list[str] | str, text: str, between: str = "") -> DataFrame:
    """``key, n, text``: the texts of a key's rows in order (nulls left out) and the number of rows, put together range by range and then at once.

    ``rows`` carry the number of their range (``scan(..., keep_slice=True)``); only the joined text itself is held whole.
    """
    key, order = ([x] if isinstance(x, str) else list(x) for x in (key, order))
    item = F.when(F.col(text).isNotNull(), F.struct(*order, F.col(text).alias("__t")))
    join = lambda parts: F.array_join(F.transform(F.sort_array(parts), lambda x: x["__t"]), between)
    pieces = rows.groupBy(*key, SLICE).agg(F.count("*").alias("n"), F.collect_list(item).alias("__x"))
    pieces = pieces.select(*key, "n", F.struct(SLICE, F.when(F.size("__x") > 0, join(F.col("__x"))).alias("__t")).alias("__p"))
    return pieces.groupBy(*key).agg(F.sum("n").alias("n"), join(F.collect_list(F.when(F.col("__p.__t").isNotNull(), F.col("__p")))).alias("text"))
