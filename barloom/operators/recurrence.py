"""Exponentially weighted recurrences without a row-by-row loop.

``y[t] = (1-a) y[t-1] + a x[t]`` equals a weighted sum of all earlier inputs, so inside a
block of rows it is ``a d^p * sum(x d^-p)`` with ``d = 1-a`` and ``p`` the offset from the
block start. What a block inherits is one number, the value at the end of the block before, which
fades by ``d`` with every row. Two bounds make that exact to double precision:

* block length: ``d^-p`` must stay below e^500, so that nothing overflows;
* inputs older than ``46 / -ln d`` rows weigh less than 1e-20, so a block of at least that many
  rows needs nothing from before the block before it.

Spans within a factor of ten meet both with one block length; others get blocks of their own.
No row is copied, and every expression stays inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.operators.series import BY_SYMBOL, INDEX, Layout, over_lookback, running

OVERFLOW_EXPONENT = 500.0
FORGOTTEN_EXPONENT = 46.0


def alpha_of(span: int) -> float:
    if span < 1:
        raise ValueError(f"span must be at least 1, got {span}")
    return 2.0 / (span + 1)


def seeded(value: Column, alpha: float) -> Column:
    """The first value of a series enters with weight one."""
    return F.when(F.col(INDEX) == 0, value / alpha).otherwise(value)


def block_classes(alphas: list[float]) -> list[tuple[int, list[float]]]:
    """(rows of a block, alphas that share it), for alphas below one."""
    decays = sorted({(-math.log1p(-a), a) for a in alphas if a < 1.0}, reverse=True)
    classes: list[tuple[float, list[float]]] = []
    for decay, alpha in decays:
        if classes and classes[-1][0] / decay * FORGOTTEN_EXPONENT < OVERFLOW_EXPONENT - classes[-1][0]:
            classes[-1][1].append(alpha)
        else:
            classes.append((decay, [alpha]))
    return [(max(1, int(OVERFLOW_EXPONENT / decay)), members) for decay, members in classes]


def smooth(df: DataFrame, layout: Layout, entries: dict[str, tuple[Column, float]]) -> DataFrame:
    """``df`` with the averages ``{out: (entry, alpha)}``; entries are already seeded, that is
    the first one divided by its ``alpha``."""
    for out, (entry, alpha) in entries.items():
        if alpha >= 1.0:
            df = df.withColumn(out, entry)
    for rows, alphas in block_classes([a for _, a in entries.values()]):
        mine = {out: (entry, math.log1p(-a), a) for out, (entry, a) in entries.items() if a in alphas}
        df = _smooth_blocks(df, layout, rows, mine)
    return df


def _smooth_blocks(df: DataFrame, layout: Layout, rows: int, entries: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """Averages that share blocks of ``rows`` rows. All windows of a series are sorted alike:
    by the block, then the index."""
    df = df.withColumn("_cut", F.floor(F.col(INDEX) / rows))
    df = df.withColumn("_off", (F.col(INDEX) - F.col("_cut") * rows).cast("double"))
    off = F.col("_off")
    past = Window.partitionBy(*layout.keys, "_cut").orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns(
        {f"_in_{o}": a * F.exp(off * fade) * F.sum(entry * F.exp(off * -fade)).over(past) for o, (entry, fade, a) in entries.items()}
    )
    ends = {o: F.when(F.col("_off") == rows - 1, F.col(f"_in_{o}")) for o in entries}
    if layout.rows is None:
        before = Window.partitionBy(*layout.keys).orderBy("_cut", INDEX).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumns({f"_from_{o}": F.last(end, ignorenulls=True).over(before) for o, end in ends.items()})
    else:
        last = df.filter(F.col("_off") == rows - 1).select(
            *layout.keys, (F.col("_cut") + 1).alias("_cut"), *(F.col(f"_in_{o}").alias(f"_from_{o}") for o in entries)
        )
        df = df.join(last, [*layout.keys, "_cut"], "left")
    inherited = lambda o, fade: F.coalesce(F.col(f"_from_{o}"), F.lit(0.0)) * F.exp((off + 1) * fade)
    df = df.withColumns({o: F.col(f"_in_{o}") + inherited(o, fade) for o, (_, fade, _) in entries.items()})
    return df.drop("_cut", "_off", *(f"_in_{o}" for o in entries), *(f"_from_{o}" for o in entries))


def ema(df: DataFrame, spans: dict[str, int], value="close", layout: Layout = BY_SYMBOL):
    """EMA columns ``{out: span}``, seeded by the first value."""
    alphas = {out: alpha_of(s) for out, s in spans.items()}
    return smooth(df, layout, {out: (seeded(F.col(value), a), a) for out, a in alphas.items()})


def macd(
    df: DataFrame, fast=12, slow=26, signal=9, value="close", layout: Layout = BY_SYMBOL
) -> DataFrame:
    """``macd`` (fast minus slow EMA), its EMA ``macd_signal`` and ``hist``."""
    out = ema(df, {"_fast": fast, "_slow": slow}, value, layout)
    out = out.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    out = ema(out, {"macd_signal": signal}, "macd", layout)
    return out.withColumn("hist", F.col("macd") - F.col("macd_signal"))


def macd_lines(
    df: DataFrame, lines: dict[tuple[int, int, int], str], value="close", layout: Layout = BY_SYMBOL
) -> DataFrame:
    """Histograms of many ``(fast, slow, signal)`` settings in one pass.

    Each distinct EMA is computed once and shared by the settings that use it.
    """
    spans = sorted({s for fast, slow, _ in lines for s in (fast, slow)})
    d = ema(df, {f"_ema{s}": s for s in spans}, value, layout)
    pairs = sorted({(fast, slow) for fast, slow, _ in lines})
    d = d.withColumns({f"_line{a}_{b}": F.col(f"_ema{a}") - F.col(f"_ema{b}") for a, b in pairs})
    signals = {}
    for (fast, slow, signal), name in lines.items():
        alpha = alpha_of(signal)
        signals[f"_sig{name}"] = (seeded(F.col(f"_line{fast}_{slow}"), alpha), alpha)
    d = smooth(d, layout, signals)
    d = d.withColumns({name: F.col(f"_line{a}_{b}") - F.col(f"_sig{name}") for (a, b, _), name in lines.items()})
    return d.drop(*signals, *[f"_ema{s}" for s in spans], *[f"_line{a}_{b}" for a, b in pairs])


def rsi(df: DataFrame, period: int = 14, value="close", layout: Layout = BY_SYMBOL) -> DataFrame:
    """Wilder's RSI, NULL before ``period`` changes were seen.

    A flat bar scales both averages alike and keeps their ratio. So the ratio is taken on
    moving bars, where the newest change always has weight, and carried over flat ones
    however long they last.
    """
    if period < 2:
        raise ValueError(f"period must be at least 2, got {period}")
    alpha = 1.0 / period

    def changes(d: DataFrame, w: WindowSpec) -> DataFrame:
        change = F.col(value) - F.lag(value).over(w)
        seed = w.rowsBetween(-(period - 1), 0)
        d = d.withColumn("_chg", change)
        return d.withColumns(
            {
                f"_seed{sign}": F.when(
                    F.col(INDEX) == period,
                    F.avg(F.greatest(F.col("_chg") * sign, F.lit(0.0))).over(seed),
                )
                for sign in (1, -1)
            }
        )

    df = over_lookback(df, layout, period, changes)

    def entry(sign: int) -> Column:
        step = F.greatest(F.col("_chg") * sign, F.lit(0.0))
        return (
            F.when(F.col(INDEX) < period, F.lit(0.0))
            .when(F.col(INDEX) == period, F.col(f"`_seed{sign}`") / alpha)
            .otherwise(step)
        )

    out = smooth(df, layout, {"_gain": (entry(1), alpha), "_loss": (entry(-1), alpha)})
    strength = 100.0 - 100.0 / (1.0 + F.try_divide(F.col("_gain"), F.col("_loss")))
    known = F.when(F.col("_loss") <= 0, F.lit(100.0)).otherwise(strength)
    fresh = (F.col(INDEX) == period) | ((F.col(INDEX) > period) & (F.col("_chg") != 0))
    gone = ["_chg", "_seed1", "_seed-1", "_gain", "_loss"]
    return running(out.withColumn("_rsi", F.when(fresh, known)).drop(*gone), layout,
                   rsi=("last", F.col("_rsi"))).drop("_rsi")
