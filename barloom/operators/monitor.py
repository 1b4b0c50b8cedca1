"""Live risk monitor evaluated over a whole equity curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.rolling import rolling_sharpe
from barloom.operators.series import BY_SYMBOL, INDEX, Layout


def risk_monitor(
    df: DataFrame,
    max_drawdown: float = 0.15,
    min_sharpe: float = 0.0,
    window: int = 60,
    layout: Layout = BY_SYMBOL,
) -> DataFrame:
    """Latest metrics per series and the first bar on which trading would halt.

    Input has ``equity``, ``ret``, ``peak`` and ``drawdown``; the first return counts as 0.
    """
    d = df.withColumn("_r", F.coalesce("ret", F.lit(0.0)))
    d = rolling_sharpe(d, window, value="_r", out="_sharpe", first=0, layout=layout)
    w = Window.partitionBy(*layout.keys).orderBy(INDEX)
    base = F.first("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn(
        "_total", F.when(base > 0, (F.col("equity") - base) / base).otherwise(0.0)
    )
    halt = (F.col("drawdown") > max_drawdown) | (F.col("_sharpe") < min_sharpe)
    last = lambda c: F.max_by(c, F.col(INDEX))
    return d.groupBy(*layout.keys).agg(
        F.round(last("_total"), 6).alias("total_return"),
        F.round(last("drawdown"), 6).alias("current_drawdown"),
        F.round(last(F.coalesce("_sharpe", F.lit(0.0))), 4).alias("current_sharpe"),
        F.round(last("peak"), 2).alias("peak_equity"),
        F.round(last("equity"), 2).alias("current_equity"),
        F.count(F.lit(1)).alias("n_updates"),
        F.min(F.when(halt, F.col("ts"))).alias("first_halt"),
    )
