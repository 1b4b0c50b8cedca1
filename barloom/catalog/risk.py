"""Risk metrics and back-test reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom import plugins
from barloom.catalog.registry import query
from barloom.catalog.views import (
    SQL_DAILY, SQL_EQUITY, SQL_REPORT_FIELDS, closes_equity, daily_indexed, sql_backtest,
    sql_momentum, sql_report, with_sql,
)
from barloom.functions import metrics as m
from barloom.operators import signals
from barloom.plans import backtest

STATS = with_sql(SQL_EQUITY)


def per_symbol(name: str, sql: str, build):
    """Register one metric of the daily close returns."""

    @query(name, STATS + f"SELECT symbol, round({sql}, 6)::DOUBLE AS {name} FROM stats GROUP BY symbol")
    def run(spark, d):
        return (
            closes_equity(spark, d).groupBy("symbol").agg(F.round(build(), 6).alias(name))
        )

    return run


per_symbol("sharpe", "avg(ret) / stddev_samp(ret) * sqrt(252)", lambda: m.sharpe("ret"))
per_symbol(
    "sortino",
    "avg(ret) / stddev_samp(ret) FILTER (WHERE ret < 0) * sqrt(252)",
    lambda: m.sortino("ret"),
)
per_symbol("max_drawdown", "max(drawdown)", lambda: m.max_drawdown("drawdown"))
per_symbol(
    "calmar", "(power(1 + avg(ret), 252) - 1) / max(drawdown)", lambda: m.calmar("ret", "drawdown")
)
per_symbol("ann_return", "power(1 + avg(ret), 252) - 1", lambda: m.annualized_return("ret"))
per_symbol("ann_vol", "stddev_samp(ret) * sqrt(252)", lambda: m.annualized_volatility("ret"))
per_symbol(
    "hist_var", "greatest(-quantile_cont(ret, 0.05), 0)", lambda: m.historical_var("ret")
)
per_symbol(
    "param_var",
    "greatest(-(avg(ret) - 1.6448536269514722 * stddev_samp(ret)), 0)",
    lambda: m.parametric_var("ret"),
)


@query(
    "cvar",
    STATS
    + """,
c AS (SELECT symbol, quantile_cont(ret, 0.05) AS cut FROM stats GROUP BY symbol)
SELECT symbol, round(greatest(-avg(ret), 0), 6) AS cvar
FROM stats JOIN c USING (symbol) WHERE ret <= cut GROUP BY symbol""",
)
def cvar(spark, d):
    whole = Window.partitionBy("symbol")
    rows = closes_equity(spark, d).withColumn(
        "cut", F.percentile("ret", F.lit(0.05)).over(whole)
    )
    return rows.groupBy("symbol").agg(F.round(m.conditional_var("ret", "cut"), 6).alias("cvar"))


def momentum_run(spark, d, **config):
    """Daily bars through momentum signals and the simulation."""
    rows = signals.momentum(daily_indexed(spark, d), 5, 20)
    return backtest.equity_stats(backtest.simulate(rows, **config))


SQL_SIM = ",".join([SQL_DAILY, sql_momentum("daily", 5, 20), sql_backtest("sigs")])


@query(
    "backtest_long",
    with_sql(SQL_SIM)
    + """SELECT symbol, ts, signal, pos::INT AS pos, round(equity, 4) AS equity,
       round(ret, 6) + 0.0 AS ret, round(trade_ret, 6) AS trade_ret FROM sim""",
)
def backtest_long(spark, d):
    return momentum_run(spark, d).select(
        "symbol",
        "ts",
        "signal",
        "pos",
        F.round("equity", 4).alias("equity"),
        (F.round("ret", 6) + 0.0).alias("ret"),
        F.round("trade_ret", 6).alias("trade_ret"),
    )


@query(
    "win_rate",
    with_sql(SQL_SIM)
    + """SELECT symbol, coalesce(round(avg(CASE WHEN trade_ret > 0 THEN 1.0 ELSE 0.0 END)
       FILTER (WHERE trade_ret IS NOT NULL), 6), 0) AS win_rate FROM sim GROUP BY symbol""",
)
def win_rate(spark, d):
    return momentum_run(spark, d).groupBy("symbol").agg(
        F.round(m.win_rate("trade_ret"), 6).alias("win_rate")
    )


@query(
    "profit_factor",
    with_sql(SQL_SIM)
    + """SELECT symbol, round(sum(trade_ret) FILTER (WHERE trade_ret > 0)
       / -sum(trade_ret) FILTER (WHERE trade_ret < 0), 6) AS profit_factor FROM sim GROUP BY symbol""",
)
def profit_factor(spark, d):
    return momentum_run(spark, d).groupBy("symbol").agg(
        F.round(m.profit_factor("trade_ret"), 6).alias("profit_factor")
    )


@query(
    "user_metrics",
    STATS
    + """SELECT symbol, round(coalesce(sum(ret) / -sum(ret) FILTER (WHERE ret < 0), 0), 6) AS gain_to_pain,
  round(greatest(max(ret), 0) / (max(abs(ret)) + 1e-12), 6)::DOUBLE AS upside FROM stats GROUP BY symbol""",
)
def user_metrics(spark, d):
    """Metrics that a user has written over the returns of a series."""

    def gain_to_pain(rets):
        pain = -rets[rets < 0].sum()
        return rets.sum() / pain if pain > 0 else 0.0

    gain = plugins.pandas_metric(gain_to_pain)
    upside = plugins.pandas_metric(lambda rets: max(rets.max(), 0.0) / (rets.abs().max() + 1e-12))
    return closes_equity(spark, d).groupBy("symbol").agg(
        F.round(gain("ret"), 6).alias("gain_to_pain"), F.round(upside("ret"), 6).alias("upside")
    )


@query(
    "perf_report",
    with_sql(SQL_SIM, sql_report("sim")) + f"SELECT symbol, {SQL_REPORT_FIELDS} FROM rep",
)
def perf_report(spark, d):
    return backtest.report(momentum_run(spark, d), ["symbol"])


@query(
    "backtest_run",
    with_sql(
        SQL_DAILY, sql_momentum("daily", 20, 50), sql_backtest("sigs"), sql_report("sim")
    )
    + f"SELECT 'Momentum_SMA_20_50' AS strategy, symbol, {SQL_REPORT_FIELDS} FROM rep",
)
def backtest_run(spark, d):
    out = backtest.run(daily_indexed(spark, d), "momentum")
    name = signals.strategy_name("momentum", {})
    return out.withColumn("strategy", F.lit(name))


@query(
    "risk_monitor",
    with_sql(SQL_SIM)
    + """,
mon AS (
  SELECT symbol, ts, idx, equity, peak, drawdown,
    (equity - first_value(equity) OVER w) / first_value(equity) OVER w AS total_return,
    CASE WHEN idx >= 59 AND stddev_samp(coalesce(ret, 0)) OVER s > 1e-10
         THEN avg(coalesce(ret, 0)) OVER s / stddev_samp(coalesce(ret, 0)) OVER s * sqrt(252) END
      AS sharpe
  FROM sim WINDOW w AS (PARTITION BY symbol ORDER BY idx),
    s AS (PARTITION BY symbol ORDER BY idx ROWS 59 PRECEDING))
SELECT symbol, round(arg_max(total_return, idx), 6) AS total_return,
       round(arg_max(drawdown, idx), 6) AS current_drawdown,
       round(coalesce(arg_max(coalesce(sharpe, 0), idx), 0), 4) AS current_sharpe,
       round(arg_max(peak, idx), 2) AS peak_equity, round(arg_max(equity, idx), 2) AS current_equity,
       count(*) AS n_updates, min(ts) FILTER (WHERE drawdown > 0.15 OR sharpe < 0) AS first_halt
FROM mon GROUP BY symbol""",
)
def risk_monitor(spark, d):
    from barloom.operators.monitor import risk_monitor as monitor

    return monitor(momentum_run(spark, d))


@query(
    "backtest_ls",
    with_sql(
        SQL_DAILY,
        sql_momentum("daily", 5, 20),
        """
sers AS (SELECT symbol, list(ts ORDER BY idx) AS tss, list(open ORDER BY idx) AS os,
         list(close ORDER BY idx) AS cs, list(signal ORDER BY idx) AS sl, count(*) AS n
         FROM sigs GROUP BY symbol),
run0 AS (
  SELECT symbol, tss, os, cs, sl, n, 0::BIGINT AS i, 0 AS pos, 100000.0::DOUBLE AS cash,
         NULL::DOUBLE AS ep, NULL::DOUBLE AS trade_ret FROM sers
  UNION ALL
  SELECT symbol, tss, os, cs, sl, n, i + 1,
    CASE WHEN i + 1 = n THEN pos ELSE greatest(-1, least(1, pos + sl[i + 1])) END,
    CASE WHEN i + 1 < n AND pos = 1 AND sl[i + 1] = -1 THEN cash * 0.999 * 0.999 * os[i + 2] / ep
         WHEN i + 1 < n AND pos = -1 AND sl[i + 1] = 1
         THEN cash * (1 + 0.999 * (1 - os[i + 2] / ep) - 0.001 - 0.999 * 0.001 * os[i + 2] / ep)
         ELSE cash END,
    CASE WHEN i + 1 < n AND pos = 0 AND sl[i + 1] <> 0 THEN os[i + 2] ELSE ep END,
    CASE WHEN i + 1 < n AND pos = 1 AND sl[i + 1] = -1 THEN 0.999 * 0.999 * os[i + 2] / ep - 1
         WHEN i + 1 < n AND pos = -1 AND sl[i + 1] = 1
         THEN 0.999 * (1 - os[i + 2] / ep) - 0.001 - 0.999 * 0.001 * os[i + 2] / ep END
  FROM run0 WHERE i < n)""",
    )
    + """
SELECT symbol, tss[i] AS ts, pos, round(CASE pos WHEN 1 THEN cash * 0.999 * cs[i] / ep
       WHEN -1 THEN cash * (1 + 0.999 * (1 - cs[i] / ep) - 0.001) ELSE cash END, 3) AS equity,
       round(trade_ret, 6) AS trade_ret
FROM run0 WHERE i > 0""",
)
def backtest_ls(spark, d):
    return momentum_run(spark, d, long_only=False).select(
        "symbol",
        "ts",
        "pos",
        F.round("equity", 3).alias("equity"),
        F.round("trade_ret", 6).alias("trade_ret"),
    )
