"""How a series is spread over tasks.

Two layouts share every operator:

* ``by_symbol``: one window partition per symbol. Right for resampled bars, whose
  length per symbol is bounded by the calendar.
* ``blocked``: for tick-level series, where one symbol may hold a third of all rows.
  A series is cut into blocks of ``rows`` consecutive rows; windows run per block with
  a halo of preceding rows copied in, and running values carry over through one small
  summary row per block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

INDEX = "idx"


@dataclass(frozen=True)
class Layout:
    """Keys and order of a series, and the block length when it is cut."""

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)
    rows: int | None = None
    span_seconds: int | None = None

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def keyed(self, *keys: str) -> "Layout":
        return Layout(tuple(keys), self.order, self.rows, self.span_seconds)


BY_SYMBOL = Layout()


def blocked(rows: int = 65_536, span_seconds: int = 86_400, keys=("symbol",), order=("ts",)):
    """Layout for unbounded series. ``span_seconds`` only steers how the row index is
    counted: a time slice of that length must fit one task."""
    return Layout(tuple(keys), tuple(order), rows, span_seconds)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Place series over all cores before work that is heavy for its input size.

    The explicit count keeps adaptive execution from folding a few megabytes of bars, which
    grid runs multiply a hundredfold, into one task. Windows on ``keys`` (or on more
    columns) reuse this placement, so it replaces their shuffle.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def number_rows(df: DataFrame, layout: Layout) -> DataFrame:
    """Position of each row in its series, where the rows already lie together."""
    return df.withColumn(INDEX, F.row_number().over(layout.window).cast("long") - 1)


def index_rows(df: DataFrame, layout: Layout) -> DataFrame:
    """Add the 0-based position of each row inside its series."""
    if layout.rows is None:
        return number_rows(spread(df, *layout.keys), layout)
    first = F.col(layout.order[0])
    slice_no = F.floor(F.unix_timestamp(first.cast("timestamp")) / layout.span_seconds)
    df = df.withColumn("_slice", slice_no)
    counts = df.groupBy(*layout.keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*layout.keys)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *layout.keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy(*layout.keys, "_slice").orderBy(*layout.order)
    return (
        df.join(offsets, [*layout.keys, "_slice"])
        .withColumn(INDEX, F.row_number().over(inside) - 1 + F.col("_base"))
        .drop("_slice", "_base")
    )


def with_halo(df: DataFrame, layout: Layout, rows: int, lookback: int) -> DataFrame:
    """Assign each row to its block and to the later blocks that look back at it.

    Adds ``_blk`` (block) and ``_own`` (the row belongs to the block, it is no copy).
    Copies per row are ``lookback / rows`` on average.
    """
    home = F.floor(F.col(INDEX) / rows)
    last = F.floor((F.col(INDEX) + lookback) / rows)
    return df.withColumn("_blk", F.explode(F.sequence(home, last))).withColumn(
        "_own", F.col("_blk") == F.floor(F.col(INDEX) / rows)
    )


def over_lookback(
    df: DataFrame,
    layout: Layout,
    lookback: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
) -> DataFrame:
    """Run ``build(df, window)``, whose expressions reach at most ``lookback`` rows
    back, on indexed rows under either layout."""
    if layout.rows is None:
        return build(df, Window.partitionBy(*layout.keys).orderBy(INDEX))
    halo = with_halo(df, layout, layout.rows, lookback)
    window = Window.partitionBy(*layout.keys, "_blk").orderBy(INDEX)
    return build(halo, window).filter("_own").drop("_blk", "_own")


def running(
    df: DataFrame, layout: Layout, **values: tuple[str, Column]
) -> DataFrame:
    """Running ``sum``, ``max``, ``min``, ``last`` (non-null) and ``first`` per series.

    Blocked form: one summary row per block, an exclusive scan over the summaries,
    and a join that brings the carry back to the rows.
    """
    fold = {
        "sum": F.sum,
        "max": F.max,
        "min": F.min,
        "last": lambda c: F.last(c, ignorenulls=True),
        "first": lambda c: F.first(c, ignorenulls=True),
    }
    if layout.rows is None:
        window = (
            Window.partitionBy(*layout.keys)
            .orderBy(INDEX)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        return df.withColumns({n: fold[k](c).over(window) for n, (k, c) in values.items()})

    df = df.withColumns({f"_v_{n}": c for n, (_, c) in values.items()}).withColumn(
        "_blk", F.floor(F.col(INDEX) / layout.rows)
    )
    summary_of = {
        "sum": F.sum,
        "max": F.max,
        "min": F.min,
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(INDEX))),
        "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(INDEX))),
    }
    summary = df.groupBy(*layout.keys, "_blk").agg(
        *[summary_of[k](f"_v_{n}").alias(f"_s_{n}") for n, (k, _) in values.items()]
    )
    before = (
        Window.partitionBy(*layout.keys)
        .orderBy("_blk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = summary.select(
        *layout.keys,
        "_blk",
        *[fold[k](F.col(f"_s_{n}")).over(before).alias(f"_c_{n}") for n, (k, _) in values.items()],
    )
    inside = (
        Window.partitionBy(*layout.keys, "_blk")
        .orderBy(INDEX)
        .rowsBetween(Window.unboundedPreceding, 0)
    )

    def join_carry(name: str, kind: str) -> Column:
        here, carried = fold[kind](F.col(f"_v_{name}")).over(inside), F.col(f"_c_{name}")
        if kind == "sum":
            # An all-null prefix stays null, as it does in one window.
            return F.when(
                here.isNotNull() | carried.isNotNull(),
                F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0)),
            )
        if kind == "max":
            return F.greatest(here, carried)
        if kind == "min":
            return F.least(here, carried)
        if kind == "last":
            return F.coalesce(here, carried)
        return F.coalesce(carried, here)

    out = df.join(carry, [*layout.keys, "_blk"]).withColumns(
        {n: join_carry(n, k) for n, (k, _) in values.items()}
    )
    return out.drop("_blk", *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])
