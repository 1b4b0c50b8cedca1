"""Checks that split rows into usable and rejected, without failing the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.signals import DEFAULTS


def bars_needed(strategy: str, params: dict) -> int:
    p = DEFAULTS[strategy] | params
    return {
        "momentum": lambda: p["long_window"] + 1,
        "mean_reversion": lambda: p["window"] + 1,
        "rsi": lambda: p["period"] + 1,
        "macd": lambda: p["slow"] + p["signal_period"],
    }[strategy]()


def series_status(bars: DataFrame) -> DataFrame:
    """Per symbol and strategy: is the series long enough, and what happens if not."""
    needs = F.explode(
        F.array(
            *[
                F.struct(F.lit(s).alias("strategy"), F.lit(bars_needed(s, {})).alias("need"))
                for s in DEFAULTS
            ]
        )
    ).alias("r")
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    n, need = F.col("n_bars"), F.col("r.need")
    strict = F.col("r.strategy").isin("momentum", "mean_reversion")
    status = (
        F.when(n < 2, "error: fewer than 2 rows")
        .when((n < need) & strict, "error: short series")
        .when(n < need, "all hold")
        .otherwise("ok")
    )
    return counts.select("symbol", "n_bars", needs).select(
        "symbol", F.col("r.strategy").alias("strategy"), "n_bars", status.alias("status")
    )


def valid_params(strategy: Column, p: Column) -> Column:
    """Legality of a parameter map per strategy."""
    v = lambda k: p[k]
    return (
        F.when(
            strategy == "momentum",
            (v("short_window") >= 2) & (v("long_window") >= 2)
            & (v("short_window") < v("long_window")),
        )
        .when(strategy == "mean_reversion", (v("window") >= 2) & (v("z_threshold") > 0))
        .when(
            strategy == "rsi",
            (v("period") >= 2) & (v("oversold") > 0) & (v("oversold") < v("overbought"))
            & (v("overbought") < 100),
        )
        .when(
            strategy == "macd",
            (v("fast") >= 2) & (v("fast") < v("slow")) & (v("signal_period") >= 2),
        )
        .otherwise(False)
    )


def valid_config(capital: Column, size: Column, stop_loss: Column, commission: Column) -> Column:
    return (
        (capital > 0)
        & (size > 0)
        & (size <= 1)
        & (stop_loss >= 0)
        & (stop_loss < 1)
        & (commission >= 0)
        & (commission < 0.1)
    )


def request_reason(ticker: Column, query: Column, start: Column, end: Column) -> Column:
    """First reason to reject an analysis request, or NULL."""
    t, q = F.trim(ticker), F.trim(query)
    a, b = start.try_cast("date"), end.try_cast("date")
    return (
        F.when((F.length(ticker) < 1) | (F.length(ticker) > 20), "ticker must have 1-20 characters")
        .when((F.length(query) < 5) | (F.length(query) > 500), "query must have 5-500 characters")
        .when(q == "", "query must not be empty")
        .when(a.isNull() | b.isNull(), "dates must be YYYY-MM-DD")
        .when(a >= b, "start must be before end")
        .when(t == "", "ticker must not be empty")
    )


def chart_ticker_ok(ticker: Column) -> Column:
    """At most 12 characters: letters and digits, dots and dashes."""
    t = F.upper(F.trim(ticker))
    bare = F.regexp_replace(t, "[.-]", "")
    return (F.length(t).between(1, 12)) & bare.rlike(r"^[\p{L}\p{N}]+$")


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted requests (ticker upper-cased) and rejected ones with their reason."""
    reason = request_reason(
        F.col("ticker"), F.col("query"), F.col("start_date"), F.col("end_date")
    )
    d = requests.withColumn("reason", reason)
    good = d.filter(F.col("reason").isNull()).drop("reason")
    good = good.withColumns({"ticker": F.upper(F.trim("ticker")), "query": F.trim("query")})
    return good, d.filter(F.col("reason").isNotNull())


def position_reason(ticker: Column, shares: Column, price: Column) -> Column:
    return (
        F.when(F.length(F.trim(ticker)) < 1, "ticker must not be empty")
        .when(~(shares > 0), "shares must be positive")
        .when(~(price > 0), "price must be positive")
    )


def compare_reason(tickers: Column) -> Column:
    """Comparisons take 2 to 10 tickers."""
    return F.when(~F.size(tickers).between(2, 10), "2 to 10 tickers are compared")
