"""The supplied tables seen as market data and documents; SQL text of the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.series import BY_SYMBOL, blocked, index_rows
from barloom.sources import bars as src
from barloom.sources.bars import balanced, table

#: Ticks are an unbounded series per symbol, so they use the blocked layout.
TICKS = blocked(rows=65_536, span_seconds=86_400, order=("ts", "seq"))


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "events")
        .filter(F.col("value") > 0)
        .select(
            F.col("event_type").alias("symbol"),
            "ts",
            F.col("value").alias("price"),
            F.lit(1.0).alias("size"),
            F.col("event_id").alias("seq"),
        )
    )


def raw_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Ticks with their non-positive prices kept."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("value").alias("close"),
        F.col("event_id").alias("seq"),
    )


def prose(spark: SparkSession, d: str) -> DataFrame:
    """Documents, spread for text work."""
    return balanced(table(spark, d, "documents"))


def index_price() -> F.Column:
    return 100 + F.col("l_extendedprice") / F.col("l_quantity") / 1000


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars per brand."""
    rows = (
        balanced(table(spark, d, "lineitem"))
        .join(
            table(spark, d, "part").select("p_partkey", "p_brand"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
        .withColumnsRenamed({"p_brand": "symbol", "l_shipdate": "ts"})
    )
    return src.ohlcv(
        rows,
        ["symbol", "ts"],
        index_price(),
        F.col("l_quantity"),
        src.order_key(
            (F.col("l_orderkey"), 13), (F.col("l_linenumber"), 2), (F.col("l_partkey"), 12),
            (F.round(F.col("l_extendedprice") * 100).cast("long"), 11),
        ),
    )


def daily_indexed(spark: SparkSession, d: str) -> DataFrame:
    return index_rows(daily(spark, d), BY_SYMBOL)


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return src.resample(ticks(spark, d), "60m")


def lots(spark: SparkSession, d: str) -> DataFrame:
    """One bought lot per order line."""
    li = balanced(table(spark, d, "lineitem"))
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    return (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("account"),
            F.col("p_brand").alias("ticker"),
            F.col("l_quantity").alias("shares"),
            index_price().alias("entry_price"),
            F.col("o_orderdate").alias("entry_date"),
            F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(
                F.col("o_orderpriority")
            ).alias("notes"),
            F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias(
                "seq"
            ),
        )
    )


def closes_equity(spark: SparkSession, d: str) -> DataFrame:
    """Daily closes as an equity curve with returns and drawdowns."""
    from barloom.plans.backtest import equity_stats

    return equity_stats(daily_indexed(spark, d).withColumn("equity", F.col("close")))


# --- SQL twins -------------------------------------------------------------------------

SQL_TICKS = """
ticks AS (
  SELECT event_type AS symbol, ts, value AS price, 1.0::DOUBLE AS size, event_id AS seq
  FROM events WHERE value > 0)"""

SQL_DAILY0 = """
daily0 AS (
  SELECT symbol, ts, arg_min(px, o) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, o) AS close, sum(l_quantity) AS volume
  FROM (SELECT p_brand AS symbol, l_shipdate AS ts, l_quantity,
               100 + l_extendedprice / l_quantity / 1000 AS px,
               (l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS o
        FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY symbol, ts)"""

SQL_DAILY = (
    SQL_DAILY0
    + """,
daily AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM daily0)"""
)

SQL_HOURLY = (
    SQL_TICKS
    + """,
hourly AS (
  SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, (ts, seq)) AS open,
         max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close,
         sum(size) AS volume
  FROM ticks GROUP BY symbol, date_trunc('hour', ts))"""
)

SQL_LOTS = """
lots AS (
  SELECT o_custkey AS account, p_brand AS ticker, l_quantity AS shares,
         100 + l_extendedprice / l_quantity / 1000 AS entry_price, o_orderdate AS entry_date,
         CASE WHEN l_returnflag = 'N' THEN '' ELSE o_orderpriority END AS notes,
         (o_orderdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""

SQL_EQUITY = (
    SQL_DAILY
    + """,
stats0 AS (
  SELECT symbol, ts, idx, close AS equity,
         close / lag(close) OVER w - 1 AS ret0,
         (close - lag(close) OVER w) / lag(close) OVER w AS ret,
         max(close) OVER w AS peak
  FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
stats AS (
  SELECT *, CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END AS drawdown FROM stats0)"""
)


def sql_backtest(source: str, keys: str = "symbol", out: str = "sim") -> str:
    """Long-only simulation over ``source(keys, idx, open, close, signal)``."""
    w = f"(PARTITION BY {keys} ORDER BY idx)"
    return f"""
{out}_a AS (
  SELECT *, lead(open) OVER {w} AS fill FROM {source}),
{out}_b AS (
  SELECT *, coalesce(last_value(CASE WHEN fill IS NOT NULL AND signal <> 0 THEN signal END
                     IGNORE NULLS) OVER {w}, 0) = 1 AS pos FROM {out}_a),
{out}_c AS (
  SELECT *, coalesce(lag(pos) OVER {w}, false) AS was FROM {out}_b),
{out}_d AS (
  SELECT *, last_value(CASE WHEN pos AND NOT was THEN fill END IGNORE NULLS) OVER {w} AS ep
  FROM {out}_c),
{out}_e AS (
  SELECT *, CASE WHEN was AND NOT pos THEN 0.999 * 0.999 * fill / ep - 1 END AS trade_ret
  FROM {out}_d),
{out}_f AS (
  SELECT *, 100000 * exp(sum(coalesce(ln(1 + trade_ret), 0)) OVER {w}) AS cash FROM {out}_e),
{out}_g AS (
  SELECT *, CASE WHEN pos THEN cash * 0.999 * close / ep ELSE cash END AS equity FROM {out}_f),
{out}_h AS (
  SELECT *, round((equity - lag(equity) OVER {w}) /
            CASE WHEN lag(equity) OVER {w} > 0 THEN lag(equity) OVER {w} ELSE 1 END, 12) AS ret,
         max(equity) OVER {w} AS peak FROM {out}_g),
{out} AS (
  SELECT *, CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END AS drawdown
  FROM {out}_h)"""


def sql_report(source: str, keys: str = "symbol", out: str = "rep") -> str:
    """Unrounded report fields per ``keys``."""
    return f"""
{out}_cut AS (
  SELECT {keys}, quantile_cont(ret, 0.05) AS cut FROM {source} GROUP BY {keys}),
{out} AS (
  SELECT {keys},
    CASE WHEN count(*) > 1 THEN arg_max(equity, idx) / arg_min(equity, idx) - 1 ELSE 0 END
      AS total_return,
    coalesce(power(1 + avg(ret), 252) - 1, 0) AS annualized_return,
    CASE WHEN count(ret) < 2 THEN 0 ELSE stddev_samp(ret) * sqrt(252) END AS annualized_volatility,
    CASE WHEN count(ret) < 2 OR stddev_samp(ret) < 1e-10 THEN 0
         ELSE avg(ret) / stddev_samp(ret) * sqrt(252) END AS sharpe_ratio,
    CASE WHEN count(ret) < 2 THEN 0
         WHEN count(*) FILTER (WHERE ret < 0) < 2 THEN NULL
         WHEN stddev_samp(ret) FILTER (WHERE ret < 0) < 1e-10 THEN 0
         ELSE avg(ret) / stddev_samp(ret) FILTER (WHERE ret < 0) * sqrt(252) END AS sortino_ratio,
    coalesce(max(drawdown), 0) AS max_drawdown,
    CASE WHEN coalesce(max(drawdown), 0) < 1e-10 THEN 0
         ELSE (power(1 + avg(ret), 252) - 1) / max(drawdown) END AS calmar_ratio,
    greatest(-any_value(cut), 0) AS var_95,
    greatest(-(avg(ret) FILTER (WHERE ret <= cut)), 0) AS cvar_95,
    coalesce(avg(CASE WHEN trade_ret > 0 THEN 1.0 WHEN trade_ret IS NOT NULL THEN 0.0 END), 0)
      AS win_rate,
    CASE WHEN coalesce(-sum(trade_ret) FILTER (WHERE trade_ret < 0), 0) >= 1e-10
         THEN coalesce(sum(trade_ret) FILTER (WHERE trade_ret > 0), 0)
              / -sum(trade_ret) FILTER (WHERE trade_ret < 0)
         WHEN sum(trade_ret) FILTER (WHERE trade_ret > 0) > 0 THEN NULL ELSE 0 END AS profit_factor,
    count(trade_ret) AS n_trades, count(ret) AS n_days
  FROM {source} JOIN {out}_cut USING ({keys}) GROUP BY {keys})"""


SQL_REPORT_FIELDS = """
  round(total_return, 6)::DOUBLE AS total_return,
  round(annualized_return, 6)::DOUBLE AS annualized_return,
  round(annualized_volatility, 6)::DOUBLE AS annualized_volatility,
  round(sharpe_ratio, 4)::DOUBLE AS sharpe_ratio,
  round(sortino_ratio, 4)::DOUBLE AS sortino_ratio,
  round(max_drawdown, 6)::DOUBLE AS max_drawdown,
  round(calmar_ratio, 4)::DOUBLE AS calmar_ratio,
  round(var_95, 6)::DOUBLE AS var_95,
  round(cvar_95, 6)::DOUBLE AS cvar_95,
  round(win_rate, 4)::DOUBLE AS win_rate,
  round(profit_factor, 4)::DOUBLE AS profit_factor, n_trades, n_days"""


def sql_momentum(source: str, short: int, long: int, keys: str = "symbol", out: str = "sigs") -> str:
    w = f"(PARTITION BY {keys} ORDER BY idx"
    return f"""
{out}_m AS (
  SELECT *,
    CASE WHEN idx >= {short - 1} THEN avg(close) OVER {w} ROWS {short - 1} PRECEDING) END AS ma_short,
    CASE WHEN idx >= {long - 1} THEN avg(close) OVER {w} ROWS {long - 1} PRECEDING) END AS ma_long
  FROM {source}),
{out} AS (
  SELECT *, CASE
    WHEN idx >= {long} AND lag(ma_short) OVER {w}) <= lag(ma_long) OVER {w})
         AND ma_short > ma_long THEN 1
    WHEN idx >= {long} AND lag(ma_short) OVER {w}) >= lag(ma_long) OVER {w})
         AND ma_short < ma_long THEN -1
    ELSE 0 END AS signal
  FROM {out}_m)"""


def with_sql(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts)
