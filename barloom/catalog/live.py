"""Streaming queries, drained over the supplied events and read back from their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.registry import query
from barloom.catalog.views import SQL_HOURLY, SQL_TICKS, ticks, with_sql
from barloom.streaming import alerting, live, tables, windows
from barloom.streaming.keyed import keyed_state

#: Running tables take ticks in any order of files; a closed candle waits a day for late ones.
LATE = "3650 days"

# Windows held back by the watermark never appear in append mode: a candle is closed
# once the newest tick lies a day or more after its end.
SQL_CLOSED = (
    SQL_HOURLY
    + """,
closed AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM hourly
  WHERE ts + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM ticks))"""
)


def closed(spark, d):
    return windows.candles(tables.tick_stream(spark, d))


def running(spark, d):
    return windows.candles(tables.tick_stream(spark, d), delay=LATE)


def drained(df, label):
    """The table of an append stream with keyed state, which follows the candles in one query."""
    with keyed_state(df.sparkSession):
        return tables.drain_append(df, label)


@query(
    "stream_candles",
    with_sql(SQL_HOURLY) + "SELECT symbol, ts, open, high, low, close, volume FROM hourly",
)
def stream_candles(spark, d):
    changes = tables.drain_changes(windows.plain(running(spark, d)), "candles")
    return tables.current(changes, ["symbol", "ts"])


@query(
    "stream_candles_closed",
    with_sql(SQL_CLOSED) + "SELECT symbol, ts, open, high, low, close, volume FROM closed",
)
def stream_candles_closed(spark, d):
    return tables.drain_append(windows.plain(closed(spark, d)), "closed")


@query(
    "stream_new_candles",
    with_sql(SQL_HOURLY) + "SELECT symbol, ts, true AS is_new_candle FROM hourly",
)
def stream_new_candles(spark, d):
    """First emission of each candle."""
    changes = tables.drain_changes(windows.plain(running(spark, d)), "new-candles")
    first = tables.first_seen(changes, ["symbol", "ts"])
    return first.select("symbol", "ts", F.lit(True).alias("is_new_candle"))


def sql_live_ema(span: int) -> str:
    return f"""
ser AS (SELECT symbol, list(ts ORDER BY idx) AS tss, list(close ORDER BY idx) AS cs, count(*) AS n
        FROM closed GROUP BY symbol),
em AS (
  SELECT symbol, tss, cs, n, 1::BIGINT AS i, cs[1] AS e FROM ser
  UNION ALL
  SELECT symbol, tss, cs, n, i + 1, (2.0::DOUBLE / {span + 1}) * cs[i + 1]
    + (1 - 2.0::DOUBLE / {span + 1}) * e FROM em WHERE i < n)"""


def stream_ema_rows(spark, d, span: int):
    rows = drained(live.ema_stream(windows.plain(closed(spark, d)), span), "ema")
    return rows.select(
        "symbol", "ts", "close", F.round("ema", 6).alias("ema")
    )


@query(
    "stream_ema",
    with_sql(SQL_CLOSED, sql_live_ema(20))
    + "SELECT symbol, tss[i] AS ts, cs[i] AS close, round(e, 6) AS ema FROM em",
)
def stream_ema(spark, d):
    return stream_ema_rows(spark, d, 20)


@query(
    "stream_candles_ema",
    with_sql(SQL_CLOSED, sql_live_ema(20))
    + """SELECT symbol, tss[i] AS ts, cs[i] AS close, round(e, 6) AS ema FROM em WHERE i > n - 100""",
)
def stream_candles_ema(spark, d):
    """The chart's last 100 closed candles with their average."""
    from barloom.operators.quotes import newest

    return newest(stream_ema_rows(spark, d, 20), 100).drop("rn")


SQL_ALERTS = """
al AS (
  SELECT symbol, unnest(['price_below', 'price_above', 'change_pct_below', 'change_pct_above']) AS condition,
    unnest([round(avg(price) * 0.02, 4), round(avg(price) * 6, 4), -99.0::DOUBLE, 5000.0::DOUBLE])
      AS threshold FROM ticks GROUP BY symbol)"""


def static_alerts(spark, d):
    mean = F.avg("price")
    levels = F.array(
        F.struct(F.lit("price_below").alias("condition"), F.round(mean * 0.02, 4).alias("threshold")),
        F.struct(F.lit("price_above").alias("condition"), F.round(mean * 6, 4).alias("threshold")),
        F.struct(F.lit("change_pct_below").alias("condition"), F.lit(-99.0).alias("threshold")),
        F.struct(F.lit("change_pct_above").alias("condition"), F.lit(5000.0).alias("threshold")),
    )
    rows = ticks(spark, d).groupBy("symbol").agg(levels.alias("_l"))
    return rows.select("symbol", F.inline("_l")).withColumn("note", F.lit(""))


@query(
    "stream_alerts",
    with_sql(SQL_CLOSED, SQL_ALERTS)
    + """,
days AS (
  SELECT *, first_value(open) OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts) AS day_open FROM closed),
moved AS (
  SELECT symbol, ts, close, CASE WHEN day_open > 0 THEN (close - day_open) / day_open * 100 ELSE 0 END AS change FROM days),
h AS (
  SELECT m.symbol, condition, ts, close AS price, change AS change_pct
  FROM moved m JOIN al USING (symbol)
  WHERE CASE condition WHEN 'price_below' THEN close < threshold WHEN 'price_above' THEN close > threshold
    WHEN 'change_pct_below' THEN change < threshold ELSE change > threshold END)
SELECT symbol, condition, ts, price, round(change_pct, 6) AS change_pct FROM h
QUALIFY row_number() OVER (PARTITION BY symbol, condition ORDER BY ts) = 1""",
)
def stream_alerts(spark, d):
    fired = alerting.drain(windows.plain(closed(spark, d)), static_alerts(spark, d))
    return fired.drop("message").withColumn("change_pct", F.round("change_pct", 6))


# Every strategy as one recursion over the closed candles of a symbol.
SQL_LIVE_SIGNALS = """
ser AS (
  SELECT symbol, list(ts ORDER BY idx) AS tss, list(close ORDER BY idx) AS cs, count(*) AS n,
    list(z ORDER BY idx) AS zs
  FROM (
    SELECT *, CASE WHEN idx < 19 THEN NULL WHEN stddev_samp(close) OVER v < 1e-10 THEN 0
      ELSE (close - avg(close) OVER v) / stddev_samp(close) OVER v END AS z
    FROM closed WINDOW v AS (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING))
  GROUP BY symbol),
st AS (
  SELECT symbol, tss, cs, n, zs, 1::BIGINT AS i, cs[1] AS fast, cs[1] AS slow, 0 AS momentum,
    CASE WHEN zs[1] < -2 THEN 1 WHEN zs[1] > 2 THEN -1 ELSE 0 END AS held, 0 AS mean_reversion,
    0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS rsi,
    0.0::DOUBLE AS quick, 0.0::DOUBLE AS calm, 0.0::DOUBLE AS line, 0.0::DOUBLE AS hist, 0 AS macd
  FROM ser
  UNION ALL
  SELECT symbol, tss, cs, n, zs, i, fast, slow,
    CASE WHEN fast0 <= slow0 AND fast > slow THEN 1 WHEN fast0 >= slow0 AND fast < slow THEN -1 ELSE 0 END,
    held0 + move, move, up, down,
    CASE WHEN i <= 15 THEN 0 WHEN down = 0 THEN CASE WHEN 100 > 70 THEN -1 ELSE 0 END
      WHEN 100 - 100 / (1 + up / down) < 30 THEN 1 WHEN 100 - 100 / (1 + up / down) > 70 THEN -1 ELSE 0 END,
    quick, calm, line, quick - calm - line,
    CASE WHEN i <= 26 THEN 0 WHEN hist0 < 0 AND quick - calm - line >= 0 THEN 1
      WHEN hist0 > 0 AND quick - calm - line <= 0 THEN -1 ELSE 0 END
  FROM (
    SELECT *, CASE WHEN i < 26 THEN 0.0 WHEN i = 26 THEN quick - calm ELSE 0.2::DOUBLE * (quick - calm) + 0.8::DOUBLE * line0 END AS line
    FROM (
      SELECT symbol, tss, cs, n, zs, i + 1 AS i, fast AS fast0, slow AS slow0, held AS held0, hist AS hist0, line AS line0,
        (2.0::DOUBLE / 21) * cs[i + 1] + (19.0::DOUBLE / 21) * fast AS fast,
        (2.0::DOUBLE / 51) * cs[i + 1] + (49.0::DOUBLE / 51) * slow AS slow,
        CASE WHEN zs[i + 1] IS NULL THEN 0
          WHEN held = 0 THEN CASE WHEN zs[i + 1] < -2 THEN 1 WHEN zs[i + 1] > 2 THEN -1 ELSE 0 END
          WHEN held = 1 THEN CASE WHEN zs[i + 1] >= 0 THEN -1 ELSE 0 END
          ELSE CASE WHEN zs[i + 1] <= 0 THEN 1 ELSE 0 END END AS move,
        CASE WHEN i <= 14 THEN up + greatest(cs[i + 1] - cs[i], 0) / 14 ELSE (13 * up + greatest(cs[i + 1] - cs[i], 0)) / 14 END AS up,
        CASE WHEN i <= 14 THEN down + greatest(cs[i] - cs[i + 1], 0) / 14 ELSE (13 * down + greatest(cs[i] - cs[i + 1], 0)) / 14 END AS down,
        CASE WHEN i + 1 < 26 THEN 0.0 WHEN i + 1 = 26 THEN list_avg(cs[15:26])
          ELSE (2.0::DOUBLE / 13) * cs[i + 1] + (11.0::DOUBLE / 13) * quick END AS quick,
        CASE WHEN i + 1 < 26 THEN 0.0 WHEN i + 1 = 26 THEN list_avg(cs[1:26])
          ELSE (2.0::DOUBLE / 27) * cs[i + 1] + (25.0::DOUBLE / 27) * calm END AS calm
      FROM st WHERE i < n)))"""


@query(
    "live_signals",
    with_sql(SQL_CLOSED, SQL_LIVE_SIGNALS) + "SELECT symbol, tss[i] AS ts, momentum, mean_reversion, rsi, macd FROM st",
)
def live_signals(spark, d):
    return drained(live.signal_stream(windows.plain(closed(spark, d))), "signals")


@query(
    "stream_session_signals",
    with_sql(SQL_CLOSED)
    + """,
g AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS begins
  FROM closed WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s AS (SELECT *, sum(begins) OVER (PARTITION BY symbol ORDER BY ts) AS sid FROM g),
ser AS (
  SELECT symbol, sid, list(ts ORDER BY ts) AS tss, list(close ORDER BY ts) AS cs, count(*) AS n FROM s GROUP BY symbol, sid),
st AS (
  SELECT symbol, tss, cs, n, 1::BIGINT AS i, cs[1] AS e, cs[1] AS fast, cs[1] AS slow, 0 AS signal FROM ser
  UNION ALL
  SELECT symbol, tss, cs, n, i + 1, e1, fast1, slow1,
    CASE WHEN fast <= slow AND fast1 > slow1 THEN 1 WHEN fast >= slow AND fast1 < slow1 THEN -1 ELSE 0 END
  FROM (
    SELECT *, cs[i + 1] / 3 + e * 2 / 3 AS e1, cs[i + 1] / 2 + fast / 2 AS fast1, cs[i + 1] * 2 / 9 + slow * 7 / 9 AS slow1
    FROM st WHERE i < n))
SELECT symbol, tss[1] AS session_start, tss[i] AS ts, cs[i] AS close, round(e, 6) AS ema, signal FROM st""",
)
def stream_session_signals(spark, d):
    """Average and signal of every candle since its session began, an hour without ticks ending one."""
    rows = drained(live.session_stream(closed(spark, d), gap_seconds=3600), "session-signals")
    return rows.select("symbol", "session_start", "ts", "close", F.round("ema", 6).alias("ema"), "signal")


@query("stream_paper_ledger")
def stream_paper_ledger(spark, d):
    params = {"short_window": 5, "long_window": 10}
    return drained(live.ledger_stream(windows.plain(closed(spark, d)), "momentum", params, max_drawdown=0.15), "ledger")


@query("ledger_summary")
def ledger_summary(spark, d):
    return live.ledger_summary(stream_paper_ledger(spark, d))


@query(
    "stream_sessions",
    with_sql(SQL_TICKS)
    + """,
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts
      FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY symbol ORDER BY ts, seq) AS sid FROM g)
SELECT symbol, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n,
  min(price) AS low, max(price) AS high
FROM s GROUP BY symbol, sid
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM ticks)""",
)
def stream_sessions(spark, d):
    return tables.drain_append(windows.sessions(tables.tick_stream(spark, d)), "sessions")


@query("stream_dedup", with_sql(SQL_TICKS) + "SELECT DISTINCT symbol, price FROM ticks")
def stream_dedup(spark, d):
    rows = windows.unique(tables.tick_stream(spark, d), ["symbol", "price"], "365 days")
    return tables.drain_append(rows, "unique").select("symbol", "price")


@query(
    "stream_sliding",
    with_sql(SQL_TICKS)
    + """,
x AS (SELECT symbol, price, date_trunc('hour', ts) - to_hours(k) AS ts
      FROM ticks CROSS JOIN (SELECT unnest(range(0, 6)) AS k))
SELECT symbol, ts, count(*) AS n, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std
FROM x GROUP BY symbol, ts""",
)
def stream_sliding(spark, d):
    changes = tables.drain_changes(windows.sliding(tables.tick_stream(spark, d), delay=LATE), "sliding")
    return tables.current(changes, ["symbol", "ts"]).withColumns(
        {"mean": F.round("mean", 6), "std": F.round("std", 6)}
    )
