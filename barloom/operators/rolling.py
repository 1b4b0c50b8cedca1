"""Trailing-window statistics. All of them take indexed rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.operators.series import BY_SYMBOL, INDEX, Layout, over_lookback

TINY = 1e-10
YEAR = 252
ROOT_YEAR = math.sqrt(YEAR)


def frame(window: WindowSpec, size: int) -> WindowSpec:
    return window.rowsBetween(-(size - 1), 0)


def full(size: int, first: int = 0) -> Column:
    """True once ``size`` values have been seen; ``first`` is the first valid index."""
    return F.col(INDEX) >= size - 1 + first


def check_window(size: int, least: int = 1) -> None:
    if size < least:
        raise ValueError(f"window must be at least {least}, got {size}")


def rolling_mean(df, size: int, value="close", out="sma", layout: Layout = BY_SYMBOL) -> DataFrame:
    """Simple moving average, NULL until the window is full."""
    check_window(size)
    return over_lookback(
        df,
        layout,
        size - 1,
        lambda d, w: d.withColumn(out, F.when(full(size), F.avg(value).over(frame(w, size)))),
    )


def rolling_means(df, sizes: dict[str, int], value="close", layout: Layout = BY_SYMBOL):
    """Several averages in one pass over one partitioning."""
    for size in sizes.values():
        check_window(size)
    return over_lookback(
        df,
        layout,
        max(sizes.values()) - 1,
        lambda d, w: d.withColumns(
            {n: F.when(full(s), F.avg(value).over(frame(w, s))) for n, s in sizes.items()}
        ),
    )


def rolling_std(
    df, size: int, value="close", out="std", ddof: int = 1, layout: Layout = BY_SYMBOL
) -> DataFrame:
    check_window(size, 2)
    fold = {0: F.stddev_pop, 1: F.stddev_samp}[ddof]
    return over_lookback(
        df,
        layout,
        size - 1,
        lambda d, w: d.withColumn(out, F.when(full(size), fold(value).over(frame(w, size)))),
    )


def rolling_sharpe(
    df, size: int, value="ret", out="sharpe", rf: float = 0.0, annualize: bool = True,
    first: int = 1, layout: Layout = BY_SYMBOL,
) -> DataFrame:
    """Rolling Sharpe of a return column whose first valid row is index ``first``."""
    check_window(size, 2)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        span = frame(w, size)
        mean = F.avg(F.col(value) - F.lit(rf)).over(span)
        std = F.stddev_samp(F.col(value) - F.lit(rf)).over(span)
        ratio = mean / std * (ROOT_YEAR if annualize else 1.0)
        return d.withColumn(out, F.when(full(size, first) & (std > TINY), ratio))

    return over_lookback(df, layout, size - 1, build)


def rolling_max_drawdown(
    df, size: int, value="close", out="mdd", layout: Layout = BY_SYMBOL
) -> DataFrame:
    """Largest fall from a peak formed inside the window itself, in one pass whatever ``size``.

    Cut the series into blocks of ``size`` rows: a window is the end of one block and the
    beginning of the next. Running values give (peak, fall) of the ends and (trough, fall) of the
    beginnings; the fall of both together is the larger one, or that from the peak of the
    end to the trough of the beginning. Values are prices or equity, of at least zero.
    """
    check_window(size)
    share = lambda peak, v: F.when(peak > 0, (peak - v) / peak).otherwise(F.lit(0.0))

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumns({"_v": F.col(value).cast("double"), "_cut": F.floor(F.col(INDEX) / size)})
        # in the order of the block, then of the row: sorted alike for blocks and for the series
        keys = [*layout.keys, *(["_blk"] if layout.rows is not None else [])]
        block = Window.partitionBy(*keys, "_cut").orderBy(INDEX)
        upto = block.rowsBetween(Window.unboundedPreceding, 0)
        onward = Window.partitionBy(*keys, "_cut").orderBy(F.desc(INDEX)).rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumns({"_peak": F.max("_v").over(onward), "_low": F.min("_v").over(onward)})
        d = d.withColumn("_end", F.max(share(F.col("_v"), F.col("_low"))).over(onward))
        d = d.withColumns({"_top": F.max("_v").over(upto), "_trough": F.min("_v").over(upto)})
        d = d.withColumn("_begin", F.max(share(F.col("_top"), F.col("_v"))).over(upto))
        whole = Window.partitionBy(*keys).orderBy("_cut", INDEX)
        d = d.withColumns({f"_was{c}": F.lag(c, size - 1).over(whole) for c in ("_peak", "_end")})
        # a window that is a block has no end of an earlier one
        across = F.when(
            (F.col(INDEX) + 1) % size != 0,
            F.greatest(F.col("_was_end"), share(F.col("_was_peak"), F.col("_trough"))),
        )
        mdd = F.greatest(F.col("_begin"), across, F.lit(0.0))
        return d.withColumn(out, F.when(full(size), mdd)).drop(
            "_v", "_cut", "_peak", "_low", "_end", "_top", "_trough", "_begin", "_was_peak", "_was_end"
        )

    return over_lookback(df, layout, size - 1, build)


def simple_returns(df, value="close", out="ret", layout: Layout = BY_SYMBOL) -> DataFrame:
    return over_lookback(
        df,
        layout,
        1,
        lambda d, w: d.withColumn(out, F.try_divide(F.col(value), F.lag(value).over(w)) - 1),
    )


def log_returns(df, value="close", out="log_ret", layout: Layout = BY_SYMBOL) -> DataFrame:
    """Log returns; NULL where either price is not positive."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        prev = F.lag(value).over(w)
        ok = (prev > 0) & (F.col(value) > 0)
        return d.withColumn(out, F.when(ok, F.ln(F.col(value) / prev)))

    return over_lookback(df, layout, 1, build)


def zscore(
    df, size: int, value="close", out="z", bands: float | None = None, layout: Layout = BY_SYMBOL
) -> DataFrame:
    """Distance from the rolling mean in sample deviations, NULL on flat windows.

    With ``bands`` the Bollinger columns ``upper, middle, lower`` are added.
    """
    check_window(size, 2)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        span = frame(w, size)
        d = d.withColumns(
            {
                "_mean": F.when(full(size), F.avg(value).over(span)),
                "_std": F.when(full(size), F.stddev_samp(value).over(span)),
            }
        )
        cols = {out: F.when(F.col("_std") > TINY, (F.col(value) - F.col("_mean")) / F.col("_std"))}
        if bands is not None:
            cols |= {
                "upper": F.col("_mean") + bands * F.col("_std"),
                "middle": F.col("_mean"),
                "lower": F.col("_mean") - bands * F.col("_std"),
            }
        return d.withColumns(cols).drop("_mean", "_std")

    return over_lookback(df, layout, size - 1, build)


def online_stats(df, size: int, value="close", layout: Layout = BY_SYMBOL) -> DataFrame:
    """Mean and deviation over the values seen so far, at most ``size`` of them.

    Unlike the batch forms these start with the first row: mean x, deviation 0.
    """
    check_window(size, 2)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        span = frame(w, size)
        return d.withColumns(
            {
                "mean": F.avg(value).over(span),
                "std": F.when(F.col(INDEX) == 0, F.lit(0.0)).otherwise(
                    F.stddev_samp(value).over(span)
                ),
            }
        )

    return over_lookback(df, layout, size - 1, build)


def online_zscore(
    df, size: int, threshold: float = 2.0, value="close", layout: Layout = BY_SYMBOL
) -> DataFrame:
    """Live z-score: 0 until the window is full or while it is flat, plus the bands."""
    out = online_stats(df, size, value, layout)
    ready = full(size) & (F.col("std") >= TINY)
    return out.withColumns(
        {
            "z": F.when(ready, (F.col(value) - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0)),
            "upper": F.col("mean") + threshold * F.col("std"),
            "lower": F.col("mean") - threshold * F.col("std"),
        }
    )


def lagged(df, columns: dict[str, tuple[str, int]], layout: Layout = BY_SYMBOL) -> DataFrame:
    """Add lagged copies: ``{out: (column, rows back)}``."""
    reach = max(n for _, n in columns.values())
    return over_lookback(
        df,
        layout,
        reach,
        lambda d, w: d.withColumns({o: F.lag(c, n).over(w) for o, (c, n) in columns.items()}),
    )
