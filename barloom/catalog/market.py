"""Scans, quotes, candles and snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.catalog.registry import query
from barloom.catalog.views import (
    SQL_DAILY, SQL_DAILY0, SQL_HOURLY, SQL_TICKS, daily, daily_indexed, ticks, with_sql,
)
from barloom.operators import quotes
from barloom.sources import bars as src


@query(
    "bars_scan",
    with_sql(SQL_DAILY0)
    + """
SELECT symbol, ts, open, high, low, close, volume FROM daily0
WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '2001-07-01'""",
)
def bars_scan(spark, d):
    upper = daily(spark, d).withColumnsRenamed({"open": "Open", "close": "Close"})
    return src.scan_bars(upper, "1996-01-01", "2001-07-01")


@query(
    "bars_hourly",
    with_sql(SQL_HOURLY) + "SELECT symbol, ts, open, high, low, close, volume FROM hourly",
)
def bars_hourly(spark, d):
    return src.resample(ticks(spark, d), "60m")


@query(
    "quote_snapshot",
    with_sql(SQL_DAILY0)
    + """,
last AS (SELECT symbol, max(ts) AS top FROM daily0 GROUP BY symbol),
r AS (SELECT d.*, row_number() OVER (PARTITION BY d.symbol ORDER BY d.ts DESC) AS rn
      FROM daily0 d JOIN last USING (symbol) WHERE d.ts > top - INTERVAL 365 DAY)
SELECT symbol, max(close) FILTER (WHERE rn = 1) AS price,
       max(close) FILTER (WHERE rn = 2) AS prev_close,
       round((max(close) FILTER (WHERE rn = 1) - max(close) FILTER (WHERE rn = 2))
             / max(close) FILTER (WHERE rn = 2) * 100, 6) AS change_pct,
       max(high) AS week_52_high, min(low) AS week_52_low
FROM r GROUP BY symbol""",
)
def quote_snapshot(spark, d):
    return quotes.daily_quotes(daily(spark, d))


@query(
    "day_change",
    with_sql(SQL_TICKS)
    + """
SELECT symbol, date_trunc('day', ts)::DATE AS day, arg_min(price, (ts, seq)) AS day_open,
       arg_max(price, (ts, seq)) AS price,
       round((arg_max(price, (ts, seq)) - arg_min(price, (ts, seq)))
             / arg_min(price, (ts, seq)) * 100, 6) AS change_pct
FROM ticks GROUP BY symbol, date_trunc('day', ts)""",
)
def day_change(spark, d):
    return quotes.intraday_quotes(ticks(spark, d))


@query(
    "candles_resample",
    with_sql(SQL_TICKS)
    + """,
c AS (
  SELECT symbol, time_bucket(INTERVAL '30 minutes', ts) AS ts, arg_min(price, (ts, seq)) AS open,
         max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close,
         sum(size) AS volume
  FROM ticks GROUP BY symbol, time_bucket(INTERVAL '30 minutes', ts)),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM c)
SELECT symbol, ts, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low,
       round(close, 4) AS close, volume
FROM r WHERE rn <= 100""",
)
def candles_resample(spark, d):
    return src.candles(ticks(spark, d), "1mo", "30m")


@query(
    "market_snapshot",
    with_sql(SQL_DAILY0)
    + """,
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM daily0)
SELECT symbol, round(max(close) FILTER (WHERE rn = 1), 2) AS current_price,
       round((max(close) FILTER (WHERE rn = 1) / max(close) FILTER (WHERE rn = 2) - 1) * 100, 2)
         AS price_change_pct,
       max(volume) FILTER (WHERE rn = 1) AS volume, round(max(high), 2) AS week_52_high,
       round(min(low), 2) AS week_52_low, round(avg(volume), 2) AS avg_volume,
       count(*) AS n_bars
FROM r WHERE rn <= 252 GROUP BY symbol""",
)
def market_snapshot(spark, d):
    return quotes.market_snapshot(daily(spark, d))


@query(
    "price_history",
    with_sql(SQL_DAILY0)
    + """,
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM daily0)
SELECT symbol, strftime(ts, '%Y-%m-%d') AS date, round(open, 2) AS open, round(high, 2) AS high,
       round(low, 2) AS low, round(close, 2) AS close, volume::BIGINT AS volume
FROM r WHERE rn <= 252""",
)
def price_history(spark, d):
    return quotes.price_history(daily(spark, d))


@query(
    "min_bars",
    with_sql(SQL_DAILY)
    + """
SELECT symbol, s AS strategy, count(*) AS n_bars,
       CASE WHEN count(*) < 2 THEN 'error: fewer than 2 rows'
            WHEN count(*) < need AND s IN ('momentum', 'mean_reversion') THEN 'error: short series'
            WHEN count(*) < need THEN 'all hold' ELSE 'ok' END AS status
FROM daily CROSS JOIN (VALUES ('momentum', 51), ('mean_reversion', 21), ('rsi', 15), ('macd', 35))
     v(s, need)
GROUP BY symbol, s, need""",
)
def min_bars(spark, d):
    from barloom.operators.validation import series_status

    return series_status(daily(spark, d))


@query(
    "chart_stats",
    with_sql(SQL_DAILY)
    + """
SELECT symbol, ts, close - lag(close) OVER w AS change,
       (close - lag(close) OVER w) / lag(close) OVER w * 100 AS change_pct,
       round(lo - pad, 2) AS y_min, round(hi + pad, 2) AS y_max
FROM daily JOIN (
  SELECT symbol, min(low) AS lo, max(high) AS hi,
         CASE WHEN max(high) = min(low) THEN 1 ELSE (max(high) - min(low)) * 0.01 END AS pad
  FROM daily GROUP BY symbol) USING (symbol)
WINDOW w AS (PARTITION BY symbol ORDER BY idx)""",
)
def chart_stats(spark, d):
    w = Window.partitionBy("symbol").orderBy("idx")
    whole = Window.partitionBy("symbol")
    prev = F.lag("close").over(w)
    low, high = F.min("low").over(whole), F.max("high").over(whole)
    pad = F.when(high == low, 1.0).otherwise((high - low) * 0.01)
    return daily_indexed(spark, d).select(
        "symbol",
        "ts",
        (F.col("close") - prev).alias("change"),
        ((F.col("close") - prev) / prev * 100).alias("change_pct"),
        F.round(low - pad, 2).alias("y_min"),
        F.round(high + pad, 2).alias("y_max"),
    )


@query(
    "thin_series",
    with_sql(SQL_DAILY)
    + """,
n AS (SELECT symbol, greatest(count(*) // 6, 1) AS step FROM daily GROUP BY symbol)
SELECT symbol, idx, ts, close FROM daily JOIN n USING (symbol) WHERE idx % step = 0""",
)
def thin_series(spark, d):
    whole = Window.partitionBy("symbol")
    step = F.greatest(F.floor(F.count(F.lit(1)).over(whole) / 6), F.lit(1))
    return (
        daily_indexed(spark, d)
        .withColumn("_step", step)
        .filter(F.col("idx") % F.col("_step") == 0)
        .select("symbol", "idx", "ts", "close")
    )
