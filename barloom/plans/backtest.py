"""Back-tests of many series at once, as window expressions over one partitioning.

A signal on bar i fills at the open of bar i+1 and the last bar never trades; equity is
marked at the close of bar i after that fill. Capital compounds by one factor per closed
trade, so the cash curve is a running product and no bar-by-bar loop is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import metrics
from barloom.operators import signals as sig
from barloom.operators.series import BY_SYMBOL, INDEX, Layout

# Starting capital, commission per fill, and decimals per report field.
CAPITAL = 100_000.0
COMMISSION = 0.001


def running_product(factor: Column, window, positive: bool) -> Column:
    """Product of factors over an ordered frame; ``positive`` spares the sign bookkeeping, and
    there the first factor that is not above zero leaves nothing."""
    if positive:
        growth = F.exp(F.coalesce(F.sum(F.ln(F.when(factor > 0, factor))).over(window), F.lit(0.0)))
        return F.when(F.min(factor).over(window) <= 0, F.lit(0.0)).otherwise(growth)
    size = F.exp(F.sum(F.ln(F.nullif(F.abs(factor), F.lit(0.0)))).over(window))
    negatives = F.sum(F.when(factor < 0, 1).otherwise(0)).over(window)
    zeros = F.sum(F.when(factor == 0, 1).otherwise(0)).over(window)
    sign = F.when(negatives % 2 == 0, 1.0).otherwise(-1.0)
    return F.when(zeros > 0, 0.0).otherwise(F.coalesce(size, F.lit(1.0)) * sign)


def simulate(
    df: DataFrame,
    layout: Layout = BY_SYMBOL,
    capital: float = CAPITAL,
    position_size: float = 1.0,
    commission: float = COMMISSION,
    long_only: bool = True,
) -> DataFrame:
    """Add ``pos``, ``equity`` and, on closing bars, ``trade_ret``.

    Input: indexed bars with ``signal``. A short earns ``shares * (entry - price)`` less
    fees on both fills; a long earns the sale less both fees.
    """
    p, c = F.lit(position_size), F.lit(commission)
    w = Window.partitionBy(*layout.keys).orderBy(INDEX)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = sig.positions(df.withColumn("_fill", F.lead("open").over(w)), long_only, layout, "_fill")
    d = d.withColumn("_was", F.coalesce(F.lag("pos").over(w), F.lit(0)))
    enters = (F.col("pos") != 0) & (F.col("_was") == 0)
    leaves = (F.col("pos") == 0) & (F.col("_was") != 0)
    d = d.withColumn("_entry", F.last(F.when(enters, F.col("_fill")), ignorenulls=True).over(upto))

    def gain(side: Column, price: Column, closing: bool) -> Column:
        """Profit per unit of deployed capital."""
        move = price / F.col("_entry")
        keep = 1 - c
        long_gain = keep * move * (keep if closing else F.lit(1.0)) - 1
        if long_only:
            return long_gain
        short_gain = keep * (1 - move) - c - (keep * c * move if closing else F.lit(0.0))
        return F.when(side > 0, long_gain).otherwise(short_gain)

    trade = F.when(leaves, gain(F.col("_was"), F.col("_fill"), True))
    d = d.withColumn("trade_ret", trade)
    cash = F.lit(capital) * running_product(
        F.when(F.col("trade_ret").isNotNull(), 1 + p * F.col("trade_ret")).otherwise(1.0),
        upto,
        positive=long_only,
    )
    d = d.withColumn("_cash", cash)
    held = F.col("_cash") * (1 + p * gain(F.col("pos"), F.col("close"), False))
    return d.withColumn("equity", F.when(F.col("pos") != 0, held).otherwise(F.col("_cash"))).drop(
        "_was", "_fill", "_entry", "_cash"
    )


def equity_stats(df: DataFrame, layout: Layout = BY_SYMBOL) -> DataFrame:
    """Per-bar return, running peak and drawdown of ``equity``."""
    w = Window.partitionBy(*layout.keys).orderBy(INDEX)
    prev = F.lag("equity").over(w)
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns(
        {
            "ret": (F.col("equity") - prev) / F.when(prev > 0, prev).otherwise(1.0),
            "peak": peak,
        }
    ).withColumn(
        "drawdown",
        F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0),
    )


FIELDS = {
    "total_return": 6,
    "annualized_return": 6,
    "annualized_volatility": 6,
    "sharpe_ratio": 4,
    "sortino_ratio": 4,
    "max_drawdown": 6,
    "calmar_ratio": 4,
    "var_95": 6,
    "cvar_95": 6,
    "win_rate": 4,
    "profit_factor": 4,
}


def report(
    df: DataFrame, keys: list[str], rounded: bool = True, fields: list[str] | None = None
) -> DataFrame:
    """Report fields per group of ``equity_stats`` rows, in one aggregation.

    Only the tail metrics need a percentile first, and only then is one computed.
    """
    fields = fields or list(FIELDS)
    if {"var_95", "cvar_95"} & set(fields):
        ordered = Window.partitionBy(*keys).orderBy(INDEX)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        df = df.withColumn("_cut", F.percentile("ret", F.lit(0.05)).over(whole))
    first, last = F.min_by("equity", INDEX), F.max_by("equity", INDEX)
    build = {
        "total_return": lambda: F.when(F.count(F.lit(1)) > 1, last / first - 1).otherwise(0.0),
        "annualized_return": lambda: metrics.annualized_return("ret"),
        "annualized_volatility": lambda: metrics.annualized_volatility("ret"),
        "sharpe_ratio": lambda: metrics.sharpe("ret"),
        "sortino_ratio": lambda: metrics.sortino("ret"),
        "max_drawdown": lambda: metrics.max_drawdown("drawdown"),
        "calmar_ratio": lambda: metrics.calmar("ret", "drawdown"),
        "var_95": lambda: F.greatest(-F.first("_cut"), F.lit(0.0)),
        "cvar_95": lambda: metrics.conditional_var("ret", "_cut"),
        "win_rate": lambda: metrics.win_rate("trade_ret"),
        "profit_factor": lambda: metrics.profit_factor("trade_ret"),
    }
    cut = (lambda c, n: F.round(c, n)) if rounded else (lambda c, n: c)
    return df.groupBy(*keys).agg(
        *[cut(build[f](), FIELDS[f]).alias(f) for f in fields],
        F.count("trade_ret").alias("n_trades"),
        F.count("ret").alias("n_days"),
    )


def run(
    bars: DataFrame,
    strategy: str = "momentum",
    params: dict | None = None,
    layout: Layout = BY_SYMBOL,
    rounded: bool = True,
    **config,
) -> DataFrame:
    """Indexed bars to one report row per series."""
    d = sig.generate(bars, strategy, params, layout)
    rows = equity_stats(simulate(d, layout, **config), layout)
    return report(rows, list(layout.keys), rounded)
