"""Trailing windows over daily bars, and the same operators over raw ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.registry import query
from barloom.catalog.views import (
    SQL_DAILY, SQL_DAILY0, SQL_EQUITY, TICKS, closes_equity, daily, daily_indexed, raw_ticks, ticks,
    with_sql,
)
from barloom.operators import rolling as ops
from barloom.operators.series import index_rows, running
from barloom.plans import decision

W = "WINDOW w AS (PARTITION BY symbol ORDER BY idx"


def r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


@query(
    "rolling_sma",
    with_sql(SQL_DAILY)
    + f"""
SELECT symbol, ts, CASE WHEN idx >= 19 THEN round(avg(close) OVER w, 6) END AS sma
FROM daily {W} ROWS 19 PRECEDING)""",
)
def rolling_sma(spark, d):
    return ops.rolling_mean(daily_indexed(spark, d), 20).select("symbol", "ts", r("sma"))


@query(
    "rolling_std",
    with_sql(SQL_DAILY)
    + f"""
SELECT symbol, ts, CASE WHEN idx >= 19 THEN round(stddev_samp(close) OVER w, 6) END AS std,
       CASE WHEN idx >= 19 THEN round(stddev_pop(close) OVER w, 6) END AS std_pop
FROM daily {W} ROWS 19 PRECEDING)""",
)
def rolling_std(spark, d):
    out = ops.rolling_std(daily_indexed(spark, d), 20)
    out = ops.rolling_std(out, 20, out="std_pop", ddof=0)
    return out.select("symbol", "ts", r("std"), r("std_pop"))


@query(
    "rolling_sharpe",
    with_sql(SQL_EQUITY)
    + f"""
SELECT symbol, ts, CASE WHEN idx >= 60 AND stddev_samp(ret) OVER w > 1e-10
       THEN round(avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252), 6) END AS sharpe
FROM stats {W} ROWS 59 PRECEDING)""",
)
def rolling_sharpe(spark, d):
    return ops.rolling_sharpe(closes_equity(spark, d), 60).select("symbol", "ts", r("sharpe"))


@query(
    "rolling_mdd",
    with_sql(SQL_DAILY)
    + """,
pairs AS (
  SELECT a.symbol, a.idx AS hi_idx, b.idx, b.close,
         max(b.close) OVER (PARTITION BY a.symbol, a.idx ORDER BY b.idx) AS peak
  FROM daily a JOIN daily b ON a.symbol = b.symbol AND b.idx BETWEEN a.idx - 19 AND a.idx),
m AS (SELECT symbol, hi_idx, max((peak - close) / peak) AS mdd FROM pairs GROUP BY symbol, hi_idx)
SELECT d.symbol, ts, CASE WHEN d.idx >= 19 THEN round(mdd, 6) END AS mdd
FROM daily d JOIN m ON d.symbol = m.symbol AND d.idx = m.hi_idx""",
)
def rolling_mdd(spark, d):
    return ops.rolling_max_drawdown(daily_indexed(spark, d), 20).select("symbol", "ts", r("mdd"))


SQL_RAW_TICKS = """
raw AS (
  SELECT event_type AS symbol, ts, value AS close, event_id AS seq,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx
  FROM events)"""


@query(
    "simple_returns",
    with_sql(SQL_RAW_TICKS)
    + f"""
SELECT symbol, ts, seq, round(close / nullif(lag(close) OVER w, 0) - 1, 6) AS ret
FROM raw {W})""",
)
def simple_returns(spark, d):
    rows = index_rows(raw_ticks(spark, d), TICKS)
    return ops.simple_returns(rows, layout=TICKS).select("symbol", "ts", "seq", r("ret"))


@query(
    "log_returns",
    with_sql(SQL_RAW_TICKS)
    + f"""
SELECT symbol, ts, seq, CASE WHEN close > 0 AND lag(close) OVER w > 0
       THEN round(ln(close / lag(close) OVER w), 6) END AS log_ret
FROM raw {W})""",
)
def log_returns(spark, d):
    rows = index_rows(raw_ticks(spark, d), TICKS)
    return ops.log_returns(rows, layout=TICKS).select("symbol", "ts", "seq", r("log_ret"))


@query(
    "bollinger",
    with_sql(SQL_DAILY)
    + f""",
b AS (SELECT symbol, ts, idx, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s
      FROM daily {W} ROWS 19 PRECEDING))
SELECT symbol, ts, CASE WHEN idx >= 19 THEN round(m + 2 * s, 6) END AS upper,
       CASE WHEN idx >= 19 THEN round(m, 6) END AS middle,
       CASE WHEN idx >= 19 THEN round(m - 2 * s, 6) END AS lower
FROM b""",
)
def bollinger(spark, d):
    out = ops.zscore(daily_indexed(spark, d), 20, bands=2.0)
    return out.select("symbol", "ts", r("upper"), r("middle"), r("lower"))


SQL_ZS = f"""
zs0 AS (SELECT *, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s
        FROM daily {W} ROWS 19 PRECEDING)),
zs AS (SELECT *, CASE WHEN idx >= 19 AND s > 1e-10 THEN (close - m) / s END AS z FROM zs0)"""
SQL_ZSCORE = SQL_DAILY + "," + SQL_ZS


@query("zscore", with_sql(SQL_ZSCORE) + "SELECT symbol, ts, round(z, 6) AS z FROM zs")
def zscore(spark, d):
    return ops.zscore(daily_indexed(spark, d), 20).select("symbol", "ts", r("z"))


SQL_TICK_STATS = (
    """
t AS (
  SELECT event_type AS symbol, ts, event_id AS seq, value AS close,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx
  FROM events WHERE value > 0),"""
    + f"""
o AS (SELECT symbol, ts, seq, idx, close, avg(close) OVER w AS mean,
             CASE WHEN idx = 0 THEN 0 ELSE stddev_samp(close) OVER w END AS std
      FROM t {W} ROWS 19 PRECEDING))"""
)


def tick_rows(spark, d):
    return index_rows(ticks(spark, d).withColumnRenamed("price", "close"), TICKS)


@query(
    "online_stats",
    with_sql(SQL_TICK_STATS)
    + "SELECT symbol, ts, seq, round(mean, 6) AS mean, round(std, 6) AS std FROM o",
)
def online_stats(spark, d):
    out = ops.online_stats(tick_rows(spark, d), 20, layout=TICKS)
    return out.select("symbol", "ts", "seq", r("mean"), r("std"))


@query(
    "online_zscore",
    with_sql(SQL_TICK_STATS)
    + """
SELECT symbol, ts, seq, round(CASE WHEN idx < 19 OR std < 1e-10 THEN 0
       ELSE (close - mean) / std END, 6) AS z, round(mean + 2 * std, 6) AS upper,
       round(mean - 2 * std, 6) AS lower FROM o""",
)
def online_zscore(spark, d):
    out = ops.online_zscore(tick_rows(spark, d), 20, layout=TICKS)
    return out.select("symbol", "ts", "seq", r("z"), r("upper"), r("lower"))


@query(
    "online_sharpe",
    """
WITH t AS (
  SELECT event_type AS symbol, ts, event_id AS seq, value AS close,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx
  FROM events WHERE value > 0),
x AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY idx)) AS ret FROM t)
"""
    + f"""
SELECT symbol, ts, seq, CASE WHEN idx >= 60 AND stddev_samp(ret) OVER w > 1e-10
       THEN round(avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252), 6) END AS sharpe
FROM x {W} ROWS 59 PRECEDING)""",
)
def online_sharpe(spark, d):
    out = ops.log_returns(tick_rows(spark, d), out="ret", layout=TICKS)
    out = ops.rolling_sharpe(out, 60, layout=TICKS)
    return out.select("symbol", "ts", "seq", r("sharpe"))


@query(
    "running_drawdown",
    with_sql(SQL_TICK_STATS)
    + f""",
p AS (SELECT *, max(close) OVER w AS peak, first_value(close) OVER w AS base FROM t {W}))
SELECT symbol, ts, seq, peak, round((peak - close) / peak, 6) AS drawdown,
       round((close - base) / base, 6) AS total_return FROM p""",
)
def running_drawdown(spark, d):
    out = running(
        tick_rows(spark, d), TICKS, peak=("max", F.col("close")), base=("first", F.col("close"))
    )
    return out.select(
        "symbol",
        "ts",
        "seq",
        "peak",
        F.round((F.col("peak") - F.col("close")) / F.col("peak"), 6).alias("drawdown"),
        F.round((F.col("close") - F.col("base")) / F.col("base"), 6).alias("total_return"),
    )


@query(
    "sma_cross",
    with_sql(SQL_DAILY)
    + """,
m AS (SELECT symbol, ts, idx,
        CASE WHEN idx >= 4 THEN avg(close) OVER (PARTITION BY symbol ORDER BY idx ROWS 4 PRECEDING)
        END AS a,
        CASE WHEN idx >= 19 THEN avg(close) OVER (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING)
        END AS b FROM daily),
l AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM m
      WINDOW w AS (PARTITION BY symbol ORDER BY idx))
SELECT symbol, ts, CASE WHEN pa <= pb AND a > b THEN 'golden' ELSE 'death' END AS cross
FROM l WHERE idx >= 20 AND ((pa <= pb AND a > b) OR (pa >= pb AND a < b))""",
)
def sma_cross(spark, d):
    from barloom.operators import signals

    out = signals.momentum(daily_indexed(spark, d), 5, 20).filter(F.col("signal") != 0)
    kind = F.when(F.col("signal") == 1, "golden").otherwise("death")
    return out.select("symbol", "ts", kind.alias("cross"))


SQL_REGIME = """
hist AS (
  SELECT symbol, ts, round(close, 2) AS close, rn FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM daily0)
  WHERE rn <= 252),
hret AS (
  SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM hist),
regime AS (
  SELECT symbol, count(*) AS n_bars,
    CASE WHEN count(ret) >= 20 THEN stddev_samp(ret) FILTER (WHERE rn <= 20) ELSE 0.02 END
      AS volatility,
    CASE WHEN avg(close) FILTER (WHERE rn BETWEEN 5 AND 24) > 0
         THEN (avg(close) FILTER (WHERE rn <= 20) - avg(close) FILTER (WHERE rn BETWEEN 5 AND 24))
              / (avg(close) FILTER (WHERE rn BETWEEN 5 AND 24) * 5) ELSE 0 END AS slope,
    round((max(close) FILTER (WHERE rn = 1) / max(close) FILTER (WHERE rn = 2) - 1) * 100, 2)
      AS change_pct
  FROM hret GROUP BY symbol)"""


@query(
    "regime_features",
    with_sql(SQL_DAILY0, SQL_REGIME)
    + """SELECT symbol, n_bars, round(volatility, 6) AS volatility, round(slope, 8) AS slope,
       change_pct FROM regime""",
)
def regime_features(spark, d):
    out = decision.regime_features(daily(spark, d))
    return out.select("symbol", "n_bars", r("volatility"), r("slope", 8), "change_pct")
