"""Back-tests over parameter grids for every series in one job.

Indicators are computed once per distinct window length, for all combinations in the same
window pass; only then are rows multiplied by the combinations. Rows stay partitioned by
the series key throughout, so the whole search costs no shuffle beyond the one that built
the series.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import recurrence, signals
from barloom.operators.rolling import TINY, frame, full
from barloom.operators.series import BY_SYMBOL, INDEX, Layout
from barloom.operators.validation import bars_needed
from barloom.plans import backtest

# The grids searched per strategy.
SEARCH_GRIDS = {
    "momentum": {"short_window": [5, 10, 20], "long_window": [20, 30, 50, 100]},
    "mean_reversion": {"window": [10, 20, 30], "z_threshold": [1.0, 1.5, 2.0, 2.5]},
    "rsi": {"period": [7, 14, 21], "oversold": [25, 30, 35], "overbought": [65, 70, 75]},
    "macd": {"fast": [8, 12, 16], "slow": [21, 26, 30], "signal_period": [7, 9, 12]},
}

SCORES = {"sharpe": "sharpe_ratio", "total_return": "total_return", "calmar": "calmar_ratio"}


def legal(strategy: str, p: dict) -> bool:
    if strategy == "momentum":
        return p["short_window"] < p["long_window"]
    if strategy == "macd":
        return p["fast"] < p["slow"]
    if strategy == "rsi":
        return p["oversold"] < p["overbought"]
    return True


def combinations(strategy: str, grid: dict | None = None) -> list[dict]:
    """Legal parameter sets in grid order; their position is the run number."""
    grid = grid or SEARCH_GRIDS[strategy]
    sets = (dict(zip(grid, values)) for values in itertools.product(*grid.values()))
    return [p for p in sets if legal(strategy, p)]


def params_text(p: dict) -> str:
    return ",".join(f"{k}={v}" for k, v in p.items())


def runs_array(strategy: str, combos: list[dict]) -> Column:
    """The combinations as an array of ``(run, params, need)``, ready to explode."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("run"),
                F.lit(params_text(p)).alias("params"),
                F.lit(bars_needed(strategy, p)).alias("need"),
            )
            for i, p in enumerate(combos)
        ]
    )


def _crossovers(df: DataFrame, layout: Layout, combos: list[dict]) -> DataFrame:
    w = Window.partitionBy(*layout.keys).orderBy(INDEX)
    sizes = sorted({p[k] for p in combos for k in ("short_window", "long_window")})
    d = df.withColumns(
        {f"_ma{s}": F.when(full(s), F.avg("close").over(frame(w, s))) for s in sizes}
    )
    d = d.withColumns({f"_was{s}": F.lag(f"_ma{s}").over(w) for s in sizes})

    def rule(p: dict) -> Column:
        a, b = p["short_window"], p["long_window"]
        live = F.col(INDEX) >= b
        return signals.signal_of(
            live & (F.col(f"_was{a}") <= F.col(f"_was{b}")) & (F.col(f"_ma{a}") > F.col(f"_ma{b}")),
            live & (F.col(f"_was{a}") >= F.col(f"_was{b}")) & (F.col(f"_ma{a}") < F.col(f"_ma{b}")),
        )

    return d.withColumn("_signals", F.array(*[rule(p) for p in combos]))


def _rsi(df: DataFrame, layout: Layout, combos: list[dict]) -> DataFrame:
    periods = sorted({p["period"] for p in combos})
    for n in periods:
        df = recurrence.rsi(df, n, layout=layout).withColumnRenamed("rsi", f"_rsi{n}")
    w = Window.partitionBy(*layout.keys).orderBy(INDEX)
    df = df.withColumns({f"_rsi{n}": F.lag(f"_rsi{n}").over(w) for n in periods})
    rules = [
        signals.signal_of(
            F.col(f"_rsi{p['period']}") < p["oversold"], F.col(f"_rsi{p['period']}") > p["overbought"]
        )
        for p in combos
    ]
    return df.withColumn("_signals", F.array(*rules))


def _macd(df: DataFrame, layout: Layout, combos: list[dict]) -> DataFrame:
    hists = {}
    for p in combos:
        key = (p["fast"], p["slow"], p["signal_period"])
        hists[key] = "_hist" + "_".join(map(str, key))
    df = recurrence.macd_lines(df, hists, layout=layout)
    w = Window.partitionBy(*layout.keys).orderBy(INDEX)

    def rule(p: dict) -> Column:
        name = hists[p["fast"], p["slow"], p["signal_period"]]
        now, was = F.lag(name, 1).over(w), F.lag(name, 2).over(w)
        live = F.col(INDEX) >= p["slow"] + p["signal_period"]
        return signals.signal_of(live & (was < 0) & (now >= 0), live & (was > 0) & (now <= 0))

    return df.withColumn("_signals", F.array(*[rule(p) for p in combos]))


def _reversion(df: DataFrame, layout: Layout, combos: list[dict]) -> DataFrame:
    """Here the rule needs state, so rows carry z-scores into the runs."""
    w = Window.partitionBy(*layout.keys).orderBy(INDEX)
    d = df
    for n in sorted({p["window"] for p in combos}):
        span = frame(w, n)
        mean, std = F.avg("close").over(span), F.stddev_samp("close").over(span)
        d = d.withColumn(
            f"_z{n}", F.when(full(n) & (std > TINY), (F.col("close") - mean) / std)
        )
    return d.withColumn("_signals", F.array(*[F.col(f"_z{p['window']}") for p in combos]))


def lookup(values: list, run: Column) -> Column:
    """Value of a run, read from the grid instead of being carried in every row."""
    return F.array(*[F.lit(v) for v in values])[run]


def all_signals(df: DataFrame, strategy: str, combos: list[dict], layout: Layout = BY_SYMBOL):
    """Indexed bars to one row per bar and ``run``, with its ``signal``.

    Rows carry nothing but the series, the prices and the run: they are many.
    """
    build = {
        "momentum": _crossovers, "rsi": _rsi, "macd": _macd, "mean_reversion": _reversion
    }[strategy]
    d = build(df, layout, combos)
    kept = [*layout.keys, INDEX, *[c for c in ("ts", "start", "n_rows") if c in df.columns], "open", "close"]
    d = d.select(*kept, F.posexplode("_signals").alias("run", "signal"))
    if strategy != "mean_reversion":
        return d
    keyed = Layout((*layout.keys, "run"))
    d = d.withColumnRenamed("signal", "z").withColumns(
        {
            "_limit": lookup([float(p["z_threshold"]) for p in combos], F.col("run")),
            "_size": lookup([p["window"] for p in combos], F.col("run")),
        }
    )
    out = signals.reversion_signals(d, F.col("_size"), F.col("_limit"), 0.0, keyed)
    return out.drop("z", "_limit", "_size")


def simulated(df: DataFrame, strategy: str, combos: list[dict], layout: Layout = BY_SYMBOL):
    keyed = Layout((*layout.keys, "run"))
    rows = all_signals(df, strategy, combos, layout)
    return backtest.equity_stats(backtest.simulate(rows, keyed), keyed)


def describe(reports: DataFrame, strategy: str, combos: list[dict]) -> DataFrame:
    """Add the parameters of each run and the bars it needs."""
    return reports.withColumns(
        {
            "params": lookup([params_text(p) for p in combos], F.col("run")),
            "need": lookup([bars_needed(strategy, p) for p in combos], F.col("run")),
        }
    )


GRID_FIELDS = ["total_return", "sharpe_ratio", "max_drawdown", "calmar_ratio", "win_rate"]


def grid_search(
    df: DataFrame,
    strategy: str = "momentum",
    grid: dict | None = None,
    optimize_for: str = "sharpe",
    layout: Layout = BY_SYMBOL,
) -> DataFrame:
    """All runs per series ranked by score, with the gain over the default parameters.

    Runs that need more bars than the series has are left out.
    """
    combos = combinations(strategy, grid)
    defaults = {k: v for k, v in signals.DEFAULTS[strategy].items() if k in combos[0]}
    default_run = next((i for i, p in enumerate(combos) if p == defaults), -1)
    df = df.select(*layout.keys, INDEX, "open", "close")
    rep = backtest.report(
        simulated(df, strategy, combos, layout), [*layout.keys, "run"], False, GRID_FIELDS
    )
    rep = describe(rep, strategy, combos).filter(F.col("n_days") + 1 >= F.col("need"))
    score = F.round(F.col(SCORES[optimize_for]), 4)
    rep = rep.withColumn("score", score)
    ranked = Window.partitionBy(*layout.keys).orderBy(F.col("score").desc_nulls_last(), "run")
    whole = Window.partitionBy(*layout.keys)
    base = F.coalesce(F.max(F.when(F.col("run") == default_run, F.col("score"))).over(whole), F.lit(0.0))
    gain = F.when(base != 0, (F.max("score").over(whole) - base) / F.abs(base) * 100).otherwise(0.0)
    return rep.select(
        *layout.keys,
        "params",
        F.round("sharpe_ratio", 3).alias("sharpe_ratio"),
        F.round("total_return", 4).alias("total_return"),
        F.round("max_drawdown", 4).alias("max_drawdown"),
        F.round("calmar_ratio", 3).alias("calmar_ratio"),
        F.round("win_rate", 3).alias("win_rate"),
        "n_trades",
        "score",
        F.row_number().over(ranked).alias("rank"),
        base.alias("default_score"),
        F.round(gain, 1).alias("improvement_pct"),
    )
