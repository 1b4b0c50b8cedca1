"""Exponential recurrences and strategy signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.registry import query
from barloom.catalog.rolling import SQL_ZSCORE, r
from barloom.catalog.views import SQL_DAILY, daily_indexed, sql_momentum, with_sql
from barloom.operators import recurrence, rolling, signals
from barloom.operators.series import BY_SYMBOL


def sql_walk(name: str, first: str, step: str) -> str:
    """Recursive walk ``name`` along all series at once.

    Each symbol's bars travel as lists, so that a step is an element access and no join.
    """
    return f"""
{name}_s AS (
  SELECT symbol, list(ts ORDER BY idx) AS tss, list(close ORDER BY idx) AS cs, count(*) AS n
  FROM daily GROUP BY symbol),
{name} AS (
  SELECT symbol, tss, cs, n, {first} FROM {name}_s
  UNION ALL
  SELECT symbol, tss, cs, n, {step} FROM {name} WHERE i < n)"""


def sql_ema_steps(*spans: int) -> tuple[str, str]:
    first = "1::BIGINT AS i, " + ", ".join(f"cs[1] AS e{s}" for s in spans)
    step = "i + 1, " + ", ".join(
        f"(2.0::DOUBLE / {s + 1}) * cs[i + 1] + (1 - 2.0::DOUBLE / {s + 1}) * e{s}" for s in spans
    )
    return first, step


SQL_EMA = SQL_DAILY + "," + sql_walk("walk", *sql_ema_steps(12, 26))


@query(
    "ema",
    with_sql(SQL_EMA)
    + """SELECT symbol, tss[i] AS ts, round(e12, 4) AS ema_12, round(e26, 4) AS ema_26 FROM walk""",
)
def ema(spark, d):
    out = recurrence.ema(daily_indexed(spark, d), {"ema_12": 12, "ema_26": 26})
    return out.select("symbol", "ts", r("ema_12", 4), r("ema_26", 4))


SQL_MACD_WALK = (
    sql_walk(
        "macdw",
        "1::BIGINT AS i, cs[1] AS f, cs[1] AS s, 0.0::DOUBLE AS g",
        """i + 1, 2.0::DOUBLE / 13 * cs[i + 1] + 11.0::DOUBLE / 13 * f,
    2.0::DOUBLE / 27 * cs[i + 1] + 25.0::DOUBLE / 27 * s,
    0.2::DOUBLE * ((2.0::DOUBLE / 13 * cs[i + 1] + 11.0::DOUBLE / 13 * f)
      - (2.0::DOUBLE / 27 * cs[i + 1] + 25.0::DOUBLE / 27 * s)) + 0.8::DOUBLE * g""",
    )
    + """,
macd AS (
  SELECT symbol, i - 1 AS idx, tss[i] AS ts, f - s AS macd, g AS macd_signal, f - s - g AS hist
  FROM macdw)"""
)
SQL_MACD = SQL_DAILY + "," + SQL_MACD_WALK


@query(
    "macd",
    with_sql(SQL_MACD)
    + """SELECT symbol, ts, round(macd, 4) + 0.0 AS macd, round(macd_signal, 4) + 0.0 AS macd_signal,
       round(hist, 4) + 0.0 AS hist FROM macd""",
)
def macd(spark, d):
    out = recurrence.macd(daily_indexed(spark, d))
    lines = [(F.round(c, 4) + 0.0).alias(c) for c in ("macd", "macd_signal", "hist")]
    return out.select("symbol", "ts", *lines)


def sql_rsi(period: int = 14, name: str = "rsi") -> str:
    p = f"{period}.0::DOUBLE"
    gain = "greatest(cs[i + 1] - cs[i], 0)"
    loss = "greatest(cs[i] - cs[i + 1], 0)"

    def next_avg(state: str, move: str) -> str:
        return f"""CASE WHEN i < {period} THEN {state} + {move}
         WHEN i = {period} THEN ({state} + {move}) / {p}
         ELSE ({state} * ({p} - 1) + {move}) / {p} END"""

    return (
        sql_walk(
            name + "w",
            "1::BIGINT AS i, 0.0::DOUBLE AS ag, 0.0::DOUBLE AS al",
            f"i + 1, {next_avg('ag', gain)}, {next_avg('al', loss)}",
        )
        + f""",
{name} AS (
  SELECT symbol, i - 1 AS idx, tss[i] AS ts,
    CASE WHEN i - 1 >= {period} THEN CASE WHEN al = 0 THEN 100
         ELSE 100 - 100 / (1 + ag / al) END END AS rsi
  FROM {name}w)"""
    )


SQL_RSI_WALK = sql_rsi()
SQL_RSI = SQL_DAILY + "," + SQL_RSI_WALK


@query("rsi", with_sql(SQL_RSI) + "SELECT symbol, ts, round(rsi, 4) AS rsi FROM rsi")
def rsi(spark, d):
    return recurrence.rsi(daily_indexed(spark, d)).select("symbol", "ts", r("rsi", 4))


@query(
    "signals_momentum",
    with_sql(SQL_DAILY, sql_momentum("daily", 20, 50)) + "SELECT symbol, ts, signal FROM sigs",
)
def signals_momentum(spark, d):
    return signals.momentum(daily_indexed(spark, d)).select("symbol", "ts", "signal")


@query(
    "signals_momentum_ema",
    with_sql(SQL_DAILY, sql_walk("walk", *sql_ema_steps(20, 50)))
    + """,
l AS (SELECT symbol, i, tss[i] AS ts, e20, e50, lag(e20) OVER w AS p20, lag(e50) OVER w AS p50
      FROM walk WINDOW w AS (PARTITION BY symbol ORDER BY i))
SELECT symbol, ts, CASE WHEN i > 50 AND p20 <= p50 AND e20 > e50 THEN 1
       WHEN i > 50 AND p20 >= p50 AND e20 < e50 THEN -1 ELSE 0 END AS signal FROM l""",
)
def signals_momentum_ema(spark, d):
    out = signals.momentum(daily_indexed(spark, d), use_ema=True)
    return out.select("symbol", "ts", "signal")


SQL_RSI_RULE = """
rs AS (
  SELECT *, CASE WHEN lag(rsi) OVER w < 30 THEN 1 WHEN lag(rsi) OVER w > 70 THEN -1 ELSE 0 END
    AS signal FROM rsi WINDOW w AS (PARTITION BY symbol ORDER BY idx))"""
SQL_RSI_SIGNALS = SQL_RSI + "," + SQL_RSI_RULE


@query("signals_rsi", with_sql(SQL_RSI_SIGNALS) + "SELECT symbol, ts, signal FROM rs")
def signals_rsi(spark, d):
    return signals.rsi_levels(daily_indexed(spark, d)).select("symbol", "ts", "signal")


SQL_MACD_RULE = """
ms AS (
  SELECT *, CASE WHEN idx >= 35 AND lag(hist, 2) OVER w < 0 AND lag(hist, 1) OVER w >= 0 THEN 1
    WHEN idx >= 35 AND lag(hist, 2) OVER w > 0 AND lag(hist, 1) OVER w <= 0 THEN -1 ELSE 0 END
    AS signal FROM macd WINDOW w AS (PARTITION BY symbol ORDER BY idx))"""
SQL_MACD_SIGNALS = SQL_MACD + "," + SQL_MACD_RULE


@query("signals_macd", with_sql(SQL_MACD_SIGNALS) + "SELECT symbol, ts, signal FROM ms")
def signals_macd(spark, d):
    return signals.macd_cross(daily_indexed(spark, d)).select("symbol", "ts", "signal")


def sql_reversion(z: float = 2.0, window: int = 20, name: str = "auto", leave: float = 0) -> str:
    """The position automaton as a plain walk over z-scores."""
    zn = "zl[i + 1]"
    live = f"i >= {window} AND {zn} IS NOT NULL"
    move = f"""CASE WHEN NOT ({live}) THEN 0
      WHEN pos = 0 AND {zn} < -{z} THEN 1 WHEN pos = 0 AND {zn} > {z} THEN -1
      WHEN pos = 1 AND {zn} >= {leave} THEN -1 WHEN pos = -1 AND {zn} <= {leave} THEN 1 ELSE 0 END"""
    return f"""
{name}_l AS (
  SELECT symbol, list(ts ORDER BY idx) AS tss, list(z ORDER BY idx) AS zl, count(*) AS n
  FROM zs GROUP BY symbol),
{name} AS (
  SELECT symbol, tss, zl, n, 1::BIGINT AS i, 0 AS pos, 0 AS signal FROM {name}_l
  UNION ALL
  SELECT symbol, tss, zl, n, i + 1, pos + {move}, {move} FROM {name} WHERE i < n)"""


SQL_REVERSION = SQL_ZSCORE + "," + sql_reversion()


@query(
    "mr_signals", with_sql(SQL_REVERSION) + "SELECT symbol, tss[i] AS ts, signal FROM auto"
)
def mr_signals(spark, d):
    return signals.mean_reversion(daily_indexed(spark, d)).select("symbol", "ts", "signal")


SQL_FAR_EXIT = SQL_ZSCORE + "," + sql_reversion(1.0, leave=1.5) + "," + sql_reversion(1.0, name="under", leave=-2.2)


@query(
    "mr_signals_far_exit",
    with_sql(SQL_FAR_EXIT)
    + """SELECT symbol, ts, o.signal AS over, u.signal AS under
FROM (SELECT symbol, tss[i] AS ts, signal FROM auto) o JOIN (SELECT symbol, tss[i] AS ts, signal FROM under) u USING (symbol, ts)""",
)
def mr_signals_far_exit(spark, d):
    """Exit levels outside the entry levels, above and below them."""
    z = rolling.zscore(daily_indexed(spark, d), 20)
    over = signals.reversion_signals(z, 20, 1.0, 1.5, BY_SYMBOL).withColumnRenamed("signal", "over")
    both = signals.reversion_signals(over, 20, 1.0, -2.2, BY_SYMBOL)
    return both.select("symbol", "ts", "over", F.col("signal").alias("under"))


@query(
    "ls_positions",
    with_sql(SQL_REVERSION)
    + """,
sg AS (SELECT symbol, list(tss[i] ORDER BY i) AS tl, list(signal ORDER BY i) AS sl, max(n) AS n
       FROM auto GROUP BY symbol),
w2 AS (
  SELECT symbol, tl, sl, n, 1::BIGINT AS i, sl[1] AS pos FROM sg
  UNION ALL
  SELECT symbol, tl, sl, n, i + 1,
    CASE WHEN i + 1 = n THEN pos ELSE greatest(-1, least(1, pos + sl[i + 1])) END FROM w2 WHERE i < n)
SELECT symbol, tl[i] AS ts, pos FROM w2""",
)
def ls_positions(spark, d):
    out = signals.mean_reversion(daily_indexed(spark, d))
    return signals.positions(out, long_only=False).select("symbol", "ts", "pos")
