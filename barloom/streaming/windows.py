"""Event-time windows: candles, sliding statistics, sessions, duplicates.

All of them aggregate map-side before the shuffle, so a busy symbol is spread over the
tasks that read its ticks. Rows later than the watermark are dropped and counted in the
query's progress (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.bars import tick_order

#: How far a tick may lag behind the newest one and still count.
DELAY = "1 day"


def candles(ticks: DataFrame, interval: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """OHLCV per symbol and window. In append mode only closed candles come out."""
    order = tick_order()
    rows = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", interval)).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
    )
    return rows


def plain(rows: DataFrame) -> DataFrame:
    """Candles with the window start as plain ``ts``."""
    return rows.select(
        "symbol",
        F.col("window.start").cast("timestamp_ntz").alias("ts"),
        "open", "high", "low", "close", "volume",
    )


def sliding(ticks: DataFrame, length="6 hours", step="1 hour", delay=DELAY) -> DataFrame:
    """Moving mean and deviation by event time."""
    rows = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", length, step)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("price").alias("mean"),
        F.stddev_samp("price").alias("std"),
    )
    return rows.select(
        "symbol", F.col("window.start").cast("timestamp_ntz").alias("ts"), "n", "mean", "std"
    )


def sessions(ticks: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Trading sessions: a symbol's ticks with no longer pause than ``gap``."""
    rows = ticks.withWatermark("ts", delay).groupBy("symbol", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
    )
    return rows.select(
        "symbol",
        F.col("session_window.start").cast("timestamp_ntz").alias("session_start"),
        F.col("session_window.end").cast("timestamp_ntz").alias("session_end"),
        "n", "low", "high",
    )


def unique(rows: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First row per key within the watermark delay."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
