"""Dated events around a reference date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_events(events: DataFrame, asks: DataFrame) -> DataFrame:
    """First event strictly after each ask: ``events(ticker, date)``, ``asks(ticker, date)``.

    Both sides are reduced to distinct days first, so the ordered pass per ticker is bounded
    by the calendar; rows come back through an equi-join on ``(ticker, date)``.
    """
    days = (
        events.select("ticker", "date", F.lit(True).alias("_event"))
        .unionByName(asks.select("ticker", "date", F.lit(False).alias("_event")))
        .groupBy("ticker", "date")
        .agg(F.max("_event").alias("_event"))
    )
    # from the last day backwards, so that the frame grows row by row
    later = Window.partitionBy("ticker").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(F.col("_event"), F.col("date")), ignorenulls=True).over(later)
    known = days.withColumn("next_date", found).select("ticker", "date", "next_date")
    return asks.join(known, ["ticker", "date"])


def earnings_calendar(tickers: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Next event per ticker seen from ``as_of``, or the last one if none is ahead. The calendar
    reads by ``days_until_earnings``, unknown ones last; sorting is left to whoever shows it."""
    now = F.lit(as_of).cast("timestamp_ntz")
    found = events.groupBy("ticker").agg(
        F.min(F.when(F.col("date") > now, F.col("date"))).alias("_ahead"),
        F.max(F.when(F.col("date") <= now, F.col("date"))).alias("_behind"),
    )
    at = F.coalesce("_ahead", "_behind")
    seconds = F.unix_timestamp(at.cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))
    d = tickers.join(found, "ticker", "left").withColumns(
        {"_at": at, "days_until_earnings": F.floor(seconds / 86400).cast("int")}
    )
    days = F.col("days_until_earnings")
    level = (
        F.when(days.isNull(), "unknown")
        .when(days < 0, "past")
        .when(days == 0, "today")
        .when(days <= 3, "critical")
        .when(days <= 7, "warning")
        .otherwise("info")
    )
    # The levels above and the texts below.
    iso, short = F.date_format("_at", "yyyy-MM-dd"), F.date_format("_at", "MMM dd")
    full = F.date_format("_at", "MMMM dd, yyyy")
    text = (
        F.when(days.isNull(), "Earnings date not available for this ticker")
        .when(days < 0, F.format_string("Last earnings: %s (%d days ago)", iso, F.abs(days)))
        .when(days == 0, "🚨 EARNINGS TODAY — Do not trade based on pre-earnings analysis!")
        .when(days <= 3, F.format_string("⚠️ Earnings in %d day(s) (%s) — HIGH RISK period", days, short))
        .when(
            days <= 7,
            F.format_string(
                "📅 Earnings in %d days (%s) — analysis may change after earnings", days, short
            ),
        )
        .otherwise(F.format_string("Next earnings: %s (%d days away)", full, days))
    )
    return d.select(
        "ticker",
        iso.alias("next_earnings_date"),
        "days_until_earnings",
        level.alias("warning_level"),
        text.alias("message"),
        F.coalesce(days.between(0, 30), F.lit(False)).alias("has_upcoming_earnings"),
    )
