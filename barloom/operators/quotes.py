"""Quotes and snapshots per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keep: int, key: str = "symbol") -> DataFrame:
    """The ``keep`` newest bars per symbol, ``rn`` = 1 for the newest.

    A bare ``row_number`` filter lets Spark cut each group before the shuffle too.
    """
    w = Window.partitionBy(key).orderBy(F.col("ts").desc())
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)


def at(rank: int, column: str):
    return F.max(F.when(F.col("rn") == rank, F.col(column)))


def daily_quotes(bars: DataFrame) -> DataFrame:
    """Last close, change against the previous close, and the one-year range."""
    whole = Window.partitionBy("symbol")
    year = bars.withColumn("_top", F.max("ts").over(whole)).filter(
        F.col("ts") > F.col("_top") - F.expr("INTERVAL 365 DAYS")
    )
    w = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return (
        year.withColumn("rn", F.row_number().over(w))
        .groupBy("symbol")
        .agg(
            at(1, "close").alias("price"),
            at(2, "close").alias("prev_close"),
            F.round((at(1, "close") - at(2, "close")) / at(2, "close") * 100, 6).alias("change_pct"),
            F.max("high").alias("week_52_high"),
            F.min("low").alias("week_52_low"),
        )
    )


def intraday_quotes(ticks: DataFrame) -> DataFrame:
    """Change against the same day's open, per symbol and day."""
    order = F.struct("ts", "seq")
    quotes = ticks.groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.min_by("price", order).alias("day_open"), F.max_by("price", order).alias("price")
    )
    change = (F.col("price") - F.col("day_open")) / F.col("day_open") * 100
    return quotes.withColumn("change_pct", F.round(change, 6))


def market_snapshot(bars: DataFrame) -> DataFrame:
    """Price, one-day change, volume and range over the last 252 bars."""
    return (
        newest(bars, 252)
        .groupBy("symbol")
        .agg(
            F.round(at(1, "close"), 2).alias("current_price"),
            F.round((at(1, "close") / at(2, "close") - 1) * 100, 2).alias("price_change_pct"),
            at(1, "volume").alias("volume"),
            F.round(F.max("high"), 2).alias("week_52_high"),
            F.round(F.min("low"), 2).alias("week_52_low"),
            F.round(F.avg("volume"), 2).alias("avg_volume"),
            F.count(F.lit(1)).alias("n_bars"),
        )
    )


def price_history(bars: DataFrame) -> DataFrame:
    """The last 252 bars as chart rows."""
    prices = [F.round(c, 2).alias(c) for c in ("open", "high", "low", "close")]
    return newest(bars, 252).select(
        "symbol",
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        *prices,
        F.col("volume").cast("long").alias("volume"),
    )
