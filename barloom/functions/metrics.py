"""Risk and return metrics as aggregate column expressions.

All take a return column (NULLs are skipped) and combine map-side. NULL stands for a
value that is not finite, such as the Sortino ratio of a series without losses.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = 252
ROOT_YEAR = math.sqrt(YEAR)
TINY = 1e-10


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def check_confidence(confidence: float) -> None:
    if not 0 < confidence < 1:
        raise ValueError(f"confidence must be in (0, 1), got {confidence}")


def sharpe(ret, rf: float = 0.0, annualize: bool = True) -> Column:
    x = col(ret) - F.lit(rf)
    std = F.stddev_samp(x)
    scale = ROOT_YEAR if annualize else 1.0
    return F.when((F.count(x) < 2) | (std < TINY), 0.0).otherwise(F.avg(x) / std * scale)


def sortino(ret, rf: float = 0.0, annualize: bool = True) -> Column:
    """Mean over the deviation of losses; one loss alone has no deviation (NULL)."""
    x = col(ret) - F.lit(rf)
    losses = F.when(x < 0, x)
    std = F.stddev_samp(losses)
    scale = ROOT_YEAR if annualize else 1.0
    return (
        F.when(F.count(x) < 2, 0.0)
        .when(F.count(losses) < 2, F.lit(None))
        .when(std < TINY, 0.0)
        .otherwise(F.avg(x) / std * scale)
    )


def annualized_return(ret) -> Column:
    return F.coalesce(F.pow(1 + F.avg(col(ret)), F.lit(YEAR)) - 1, F.lit(0.0))


def annualized_volatility(ret) -> Column:
    x = col(ret)
    return F.when(F.count(x) < 2, 0.0).otherwise(F.stddev_samp(x) * ROOT_YEAR)


def historical_var(ret, confidence: float = 0.95, exact: bool = True) -> Column:
    """Exact percentile by default; ``exact=False`` keeps a bounded sketch per group."""
    check_confidence(confidence)
    x = col(ret)
    share = F.lit(round(1 - confidence, 12))
    cut = F.percentile(x, share) if exact else F.percentile_approx(x, share, 10_000)
    return F.greatest(-cut, F.lit(0.0))


def parametric_var(ret, confidence: float = 0.95) -> Column:
    check_confidence(confidence)
    z = NormalDist().inv_cdf(1 - confidence)
    x = col(ret)
    return F.greatest(-(F.avg(x) + z * F.coalesce(F.stddev_samp(x), F.lit(0.0))), F.lit(0.0))


def conditional_var(ret, cut) -> Column:
    """Mean loss at or beyond the percentile ``cut``, a column constant per group."""
    return F.greatest(-F.avg(F.when(col(ret) <= col(cut), col(ret))), F.lit(0.0))


def max_drawdown(drawdown) -> Column:
    """Largest value of a running drawdown column."""
    return F.coalesce(F.max(col(drawdown)), F.lit(0.0))


def calmar(ret, drawdown) -> Column:
    mdd = max_drawdown(drawdown)
    return F.when(mdd < TINY, 0.0).otherwise(annualized_return(ret) / mdd)


def win_rate(trade) -> Column:
    return F.coalesce(F.avg((col(trade) > 0).cast("double")), F.lit(0.0))


def profit_factor(trade) -> Column:
    t = col(trade)
    gains = F.coalesce(F.sum(F.when(t > 0, t)), F.lit(0.0))
    losses = F.coalesce(-F.sum(F.when(t < 0, t)), F.lit(0.0))
    return F.when(losses >= TINY, gains / losses).when(gains > 0, F.lit(None)).otherwise(0.0)
