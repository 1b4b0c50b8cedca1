"""Positions, profit and loss, account roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INITIAL_CAPITAL = 100_000.0


def merge_lots(lots: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """One position per key: shares added up, price weighted by shares, the latest
    non-empty note and the first entry date. ``seq`` orders the lots."""
    noted = F.when(F.col("notes") != "", F.col("seq"))
    price = F.sum(F.col("shares") * F.col("entry_price")) / F.sum("shares")
    return lots.groupBy(*keys).agg(
        F.sum("shares").alias("shares"),
        F.round(price, digits).alias("entry_price"),
        F.min_by("entry_date", "seq").alias("entry_date"),
        F.coalesce(F.max_by("notes", noted), F.lit("")).alias("notes"),
    )


def performance(positions: DataFrame, quotes: DataFrame, digits: int | None = 2) -> DataFrame:
    """Positions valued at the latest quote; without one, at their entry price.

    ``quotes``: ``ticker, price, change_pct, week_52_high, week_52_low``, one row per ticker. A
    plain equi-join: adaptive execution sends the quotes to the positions if they turn out small, and splits
    a ticker that holds most positions if not.
    """
    d = positions.join(quotes, "ticker", "left")
    price = F.coalesce("price", "entry_price")
    cost, value = F.col("shares") * F.col("entry_price"), F.col("shares") * price
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return d.select(
        *positions.columns,
        cut(price).alias("current_price"),
        cut(F.coalesce("change_pct", F.lit(0.0))).alias("price_change_pct"),
        cut(cost).alias("cost_basis"),
        cut(value).alias("current_value"),
        cut(value - cost).alias("unrealized_pnl"),
        cut(F.when(cost > 0, (value - cost) / cost * 100).otherwise(0.0)).alias("unrealized_pnl_pct"),
        cut(F.coalesce("week_52_high", price)).alias("week_52_high"),
        cut(F.coalesce("week_52_low", price)).alias("week_52_low"),
    )


def totals(perf: DataFrame, keys: list[str]) -> DataFrame:
    """Portfolio sums with the best and worst ticker; equal ones go by name."""
    pct = F.col("unrealized_pnl_pct")
    cost, value = F.sum("cost_basis"), F.sum("current_value")
    return perf.groupBy(*keys).agg(
        F.round(cost, 2).alias("total_cost_basis"),
        F.round(value, 2).alias("total_current_value"),
        F.round(value - cost, 2).alias("total_unrealized_pnl"),
        F.round(F.when(cost > 0, (value - cost) / cost * 100).otherwise(0.0), 2).alias(
            "total_unrealized_pnl_pct"
        ),
        F.min_by("ticker", F.struct(-pct, F.col("ticker"))).alias("best_performer"),
        F.min_by("ticker", F.struct(pct, F.col("ticker"))).alias("worst_performer"),
        F.count(F.lit(1)).alias("position_count"),
    )


def account_rollup(perf: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per account: open profit and total profit against the initial capital.

    ``accounts(account, cash)``; accounts without positions are kept.
    """
    held = perf.groupBy("account").agg(
        F.sum("unrealized_pnl").alias("_pnl"),
        F.sum("current_value").alias("_value"),
        F.count(F.lit(1)).alias("_n"),
    )
    value = F.col("cash") + F.coalesce("_value", F.lit(0.0))
    return accounts.join(held, "account", "left").select(
        "account",
        "cash",
        value.alias("portfolio_value"),
        (value - INITIAL_CAPITAL).alias("total_pnl"),
        ((value - INITIAL_CAPITAL) / INITIAL_CAPITAL).alias("total_pnl_pct"),
        F.coalesce("_pnl", F.lit(0.0)).alias("unrealized_pnl"),
        F.coalesce("_n", F.lit(0)).alias("position_count"),
    )


def without(positions: DataFrame, removals: DataFrame, keys: list[str]) -> DataFrame:
    """Positions left after removals; a removal of what is not held fails the job."""
    named = removals.select(*keys).distinct().withColumn("_gone", F.lit(True))
    both = positions.withColumn("_held", F.lit(True)).join(named, keys, "full")
    absent = F.raise_error(F.lit("removal of a position that is not held")).cast("boolean")
    return both.where(F.coalesce("_held", absent) & F.col("_gone").isNull()).drop("_held", "_gone")


def cost_by(positions: DataFrame, key: str, digits: int = 2) -> DataFrame:
    cost: Column = F.sum(F.col("shares") * F.col("entry_price"))
    return positions.groupBy(key).agg(
        F.count(F.lit(1)).alias("positions"), F.round(cost, digits).alias("total_cost")
    )
