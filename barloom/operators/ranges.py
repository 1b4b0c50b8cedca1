"""Max, min or sum over arbitrary index ranges ``[l, r]`` of a series, in batches.

A series is stored in two levels: blocks of consecutive rows with their values, maximum,
minimum and sum, and one row per series with those of all its blocks. A query meets the block
of either end and the row of its series, by equi-joins, whatever its length; there is no range
join and no row per bar and length. A changed point rewrites its own block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.series import INDEX
from barloom.session import materialize

#: Rows of a block.
BLOCK_ROWS = 128


def _summed() -> dict[str, Column]:
    return {
        "top": F.array_max("hi"),
        "bottom": F.array_min("lo"),
        "total": F.aggregate("values", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))),
    }


def blocks(df: DataFrame, high: str, low: str, value: str | None = None) -> DataFrame:
    """``(symbol, blk, hi, lo, values, top, bottom, total)``: the rows of each block as arrays in the
    order of their index, and their maximum, minimum and sum. Written, as queries read it often."""
    row = F.struct(
        F.col(INDEX).alias("i"), F.col(high).cast("double").alias("hi"), F.col(low).cast("double").alias("lo"),
        F.col(value or high).cast("double").alias("v"),
    )
    packed = df.groupBy("symbol", F.floor(F.col(INDEX) / BLOCK_ROWS).alias("blk")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    arrays = packed.select("symbol", "blk", F.col("rows.hi").alias("hi"), F.col("rows.lo").alias("lo"), F.col("rows.v").alias("values"))
    return materialize(arrays.withColumns(_summed()), "range-blocks")


def series(blocks: DataFrame) -> DataFrame:
    """One row per symbol: the summaries of its blocks in their order, and its length."""
    each = F.struct("blk", "top", "bottom", "total", F.size("hi").alias("n"))
    packed = blocks.groupBy("symbol").agg(F.sort_array(F.collect_list(each)).alias("b"), F.sum(F.size("hi")).alias("rows"))
    return packed.select("symbol", "rows", F.col("b.top").alias("tops"), F.col("b.bottom").alias("bottoms"), F.col("b.total").alias("totals"))


def _part(column: str, first: Column, last: Column) -> Column:
    """Elements ``first`` to ``last``, counted from 0; null if there are none."""
    count = (last - first + 1).cast("int")
    return F.when(count > 0, F.slice(column, (first + 1).cast("int"), F.greatest(count, F.lit(0))))


def _sum(values: Column) -> Column:
    return F.coalesce(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), F.lit(0.0))


def answer(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries(symbol, l, r, ...)`` with ``hi, lo, total`` of their ranges, both ends included.

    A query with ``l > r``, of an unknown series or outside its series fails the job.
    """
    good = (F.col("l") >= 0) & (F.col("l") <= F.col("r")) & (F.col("r") < F.col("rows"))
    fail = F.raise_error(F.lit("bad range")).cast("long")
    first, last = F.floor(F.col("l") / BLOCK_ROWS), F.floor(F.col("r") / BLOCK_ROWS)
    asked = queries.join(series(blocks), "symbol", "left")
    # the checks are part of the join keys, so no row is dropped before they are made
    asked = asked.withColumns({"_l": F.when(good, first).otherwise(fail), "_r": F.when(good, last).otherwise(fail)})
    between = {
        "_hi": F.array_max(_part("tops", first + 1, last - 1)),
        "_lo": F.array_min(_part("bottoms", first + 1, last - 1)),
        "_sum": _sum(_part("totals", first + 1, last - 1)),
    }
    asked = asked.withColumns(between).drop("rows", "tops", "bottoms", "totals")
    start, stop = F.col("l") % BLOCK_ROWS, F.col("r") % BLOCK_ROWS
    alone = F.col("_l") == F.col("_r")
    for end, a, b in (
        ("_l", start, F.when(alone, stop).otherwise(BLOCK_ROWS - 1)),
        ("_r", F.lit(0), F.when(alone, -1).otherwise(stop)),
    ):
        edge = blocks.select("symbol", F.col("blk").alias(end), F.col("hi").alias("_his"), F.col("lo").alias("_los"), F.col("values").alias("_vs"))
        asked = asked.join(edge, ["symbol", end]).withColumns(
            {
                "_hi": F.greatest("_hi", F.array_max(_part("_his", a, b))),
                "_lo": F.least("_lo", F.array_min(_part("_los", a, b))),
                "_sum": F.col("_sum") + _sum(_part("_vs", a, b)),
            }
        ).drop("_his", "_los", "_vs")
    return asked.drop("_l", "_r").withColumnsRenamed({"_hi": "hi", "_lo": "lo", "_sum": "total"})


def range_extremes(df: DataFrame, queries: DataFrame, high="high", low="low") -> DataFrame:
    """Highest ``high`` and lowest ``low`` per query ``(symbol, l, r)``."""
    return answer(blocks(df, high, low), queries).drop("total")


def range_sums(df: DataFrame, queries: DataFrame, value: str) -> DataFrame:
    """Sum of ``value`` per query ``(symbol, l, r)``."""
    return answer(blocks(df, value, value), queries).drop("hi", "lo")


def updated(stored: DataFrame, df: DataFrame, updates: DataFrame, version) -> DataFrame:
    """``stored`` blocks of one column of ``df`` after point updates ``(symbol, ts, value)``; the latest
    version of a point wins.

    Updates are folded to one row per point and one per block, so a point that was corrected
    very often costs no more than others, and only blocks with a changed point are computed anew. An update of a
    point that is not there fails the job.
    """
    latest = updates.groupBy("symbol", "ts").agg(F.max_by("value", version).alias("_new"))
    places = df.select("symbol", "ts", F.col(INDEX).alias("_at"))
    at = F.coalesce("_at", F.raise_error(F.lit("update of an unknown point")).cast("long"))
    points = latest.join(places, ["symbol", "ts"], "left").select("symbol", at.alias("_at"), "_new")
    per = points.groupBy("symbol", F.floor(F.col("_at") / BLOCK_ROWS).alias("blk")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("_at") % BLOCK_ROWS).cast("int"), "_new"))).alias("_points")
    )
    fixed = F.transform("hi", lambda v, i: F.coalesce(F.element_at("_points", i), v))
    met = stored.join(per, ["symbol", "blk"], "left")
    same = met.where("_points is null").select(*stored.columns)
    new = met.where("_points is not null").select("symbol", "blk", fixed.alias("hi"))
    new = new.withColumns({"lo": F.col("hi"), "values": F.col("hi")}).withColumns(_summed())
    return same.union(new.select(*stored.columns))


def first_reach(stored: DataFrame, starts: DataFrame, reach: int) -> DataFrame:
    """``starts(symbol, idx, level, up, ...)`` with ``after``: rows from ``idx`` to the first one, itself included
    and at most ``reach`` rows on, whose value is at or beyond the level; null if there is none.

    A start meets the few blocks ahead of it, and only those whose maximum (``up``) or
    minimum reaches the level are searched.
    """
    ahead = F.sequence(F.floor(F.col(INDEX) / BLOCK_ROWS), F.floor((F.col(INDEX) + reach) / BLOCK_ROWS))
    keyed = starts.withColumn("_id", F.monotonically_increasing_id())
    each = keyed.select("_id", "symbol", INDEX, "level", "up", F.explode(ahead).alias("blk"))
    met = each.join(stored.select("symbol", "blk", "hi", "top", "bottom"), ["symbol", "blk"])
    may = F.when(F.col("up"), F.col("top") >= F.col("level")).otherwise(F.col("bottom") <= F.col("level"))
    base = F.col("blk") * BLOCK_ROWS
    hits = F.transform(
        "hi",
        lambda v, i: (base + i >= F.col(INDEX))
        & (base + i <= F.col(INDEX) + reach)
        & F.when(F.col("up"), v >= F.col("level")).otherwise(v <= F.col("level")),
    )
    place = F.array_position(hits, True)
    found = met.where(may).select("_id", F.when(place > 0, base + place - 1 - F.col(INDEX)).alias("after"))
    return keyed.join(found.groupBy("_id").agg(F.min("after").alias("after")), "_id", "left").drop("_id")
