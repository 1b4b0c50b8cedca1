"""Walk-forward validation: tune on a training slice, judge on the slice after it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import metrics
from barloom.operators.series import INDEX, Layout, number_rows, spread
from barloom.operators.validation import bars_needed
from barloom.plans import backtest, search
from barloom.session import materialize

# The smaller grids used here, and the verdict thresholds.
GRIDS = {
    "momentum": {"short_window": [5, 10, 20], "long_window": [20, 50, 100]},
    "mean_reversion": {"window": [10, 20, 30], "z_threshold": [1.5, 2.0, 2.5]},
    "rsi": {"period": [7, 14, 21], "oversold": [25, 30], "overbought": [70, 75]},
    "macd": {"fast": [8, 12], "slow": [21, 26], "signal_period": [7, 9]},
}
ROBUST = 0.7
MODERATE = 0.4
MIN_TRAIN = 30
MIN_TEST = 5
MIN_RUN = 10
BARS_PER_MONTH = 15

SLICE = ("symbol", "win")


@dataclass(frozen=True)
class Spec:
    train_months: int = 12
    test_months: int = 3
    step_months: int = 3
    strategy: str = "momentum"
    optimize_for: str = "sharpe"
    grid: dict | None = field(default=None)

    @property
    def combos(self) -> list[dict]:
        return search.combinations(self.strategy, self.grid or GRIDS[self.strategy])


def bounds(start: Column, k: Column, spec: Spec) -> dict[str, Column]:
    """Dates of window ``k`` (0-based), all counted from the first start."""
    shift = lambda extra: F.add_months(start, (k * spec.step_months + extra).cast("int"))
    return {
        "train_start": shift(0),
        "train_end": F.date_sub(shift(spec.train_months), 1),
        "test_start": shift(spec.train_months),
        "test_end": F.date_sub(shift(spec.train_months + spec.test_months), 1),
    }


def with_span(bars: DataFrame) -> DataFrame:
    whole = Window.partitionBy("symbol")
    return bars.withColumns(
        {
            "_start": F.to_date(F.min("ts").over(whole)),
            "_end": F.to_date(F.max("ts").over(whole)),
            "_n": F.count(F.lit(1)).over(whole),
        }
    )


def windows(bars: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Window dates per symbol; none where the history is too short for two windows."""
    span = bars.groupBy("symbol").agg(
        F.to_date(F.min("ts")).alias("_start"),
        F.to_date(F.max("ts")).alias("_end"),
        F.count(F.lit(1)).alias("_n"),
    )
    months = F.floor(F.months_between(F.date_add("_end", 1), "_start"))
    last = F.floor((months - spec.train_months - spec.test_months) / spec.step_months)
    wins = span.filter(
        F.col("_n") >= (spec.train_months + spec.test_months) * BARS_PER_MONTH
    ).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)))))
    wins = wins.withColumns(bounds(F.col("_start"), F.col("k"), spec)).filter(
        F.col("test_end") <= F.col("_end")
    )
    count = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return (
        wins.withColumn("_wins", count)
        .filter("_wins >= 2")
        .select("symbol", (F.col("k") + 1).cast("int").alias("win"), "train_start", "train_end",
                "test_start", "test_end")
    )


def assign(bars: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Bars copied into every window that covers them, with ``win`` and ``phase``.

    The covering windows follow from the month arithmetic, so there is no range join: a
    bar is multiplied only by the ``(train + test) / step`` windows around it.
    """
    total = spec.train_months + spec.test_months
    d = with_span(bars).filter(F.col("_n") >= total * BARS_PER_MONTH)
    day = F.to_date("ts")
    months = (F.year(day) - F.year("_start")) * 12 + F.month(day) - F.month("_start")
    first = F.greatest(F.floor((months - total) / spec.step_months), F.lit(0))
    last = F.floor(months / spec.step_months)
    d = d.withColumn("_k", F.explode(F.sequence(first, F.greatest(last, first))))
    d = d.withColumns(bounds(F.col("_start"), F.col("_k"), spec))
    phase = F.when(day.between(F.col("train_start"), F.col("train_end")), "train").when(
        day.between(F.col("test_start"), F.col("test_end")), "test"
    )
    d = d.withColumn("phase", phase).filter(
        F.col("phase").isNotNull() & (F.col("test_end") <= F.col("_end"))
    )
    whole = Window.partitionBy("symbol")
    d = d.withColumn("_wins", F.max("_k").over(whole) + 1).filter("_wins >= 2")
    return d.withColumns({"win": (F.col("_k") + 1).cast("int"), "start": F.col("_start")}).drop(
        "_start", "_end", "_n", "_k", "_wins"
    )


def score_of(metric: str) -> Column:
    """The tuning metric of a run as an aggregate over its rows."""
    n, mean, std = F.count("ret"), F.avg("ret"), F.stddev_samp("ret")
    if metric == "sharpe":
        return F.when((n < 2) | (std < metrics.TINY), 0.0).otherwise(mean / std * metrics.ROOT_YEAR)
    if metric == "total_return":
        return F.max_by("equity", INDEX) / F.min_by("equity", INDEX) - 1
    fall = F.max("drawdown")
    yearly = F.pow(1 + mean, F.lit(metrics.YEAR)) - 1
    return F.when(fall < metrics.TINY, 0.0).otherwise(yearly / fall)


def evaluate(bars: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Simulated bars of all test slices under each window's best run.

    Training and test slices are series of their own, with indicators started afresh. Bars are folded
    and written once, as both phases read them. All runs are simulated on the training slices and fold to a score each;
    the test slices are simulated under the best run alone.

    Equal scores go to the earlier run. A run whose training slice is too short has no score
    and comes last; where the test slice is too short (``ok`` is false) nothing is traded.
    """
    d = assign(materialize(bars.select("symbol", "ts", "open", "close"), "bars"), spec)
    d = spread(d.select("symbol", "win", "phase", "ts", "open", "close", "start"), *SLICE)
    phases = Layout((*SLICE, "phase"))
    whole = Window.partitionBy(*SLICE)
    n_of = lambda phase: F.count(F.when(F.col("phase") == phase, 1)).over(whole)
    d = d.withColumns({"_train": n_of("train"), "_test": n_of("test")})
    d = d.filter((F.col("_train") >= MIN_TRAIN) & (F.col("_test") >= MIN_TEST))
    own = F.when(F.col("phase") == "train", F.col("_train")).otherwise(F.col("_test"))
    d = number_rows(d.withColumn("n_rows", own).drop("_train", "_test"), phases)

    combos, keyed = spec.combos, Layout((*phases.keys, "run"))
    need = F.greatest(
        search.lookup([bars_needed(spec.strategy, p) for p in combos], F.col("run")), F.lit(MIN_RUN)
    )

    def signals(phase: str) -> DataFrame:
        rows = search.all_signals(d.filter(F.col("phase") == phase), spec.strategy, combos, phases)
        rows = rows.withColumn("ok", F.col("n_rows") >= need)
        return rows.withColumn("signal", F.when(F.col("ok"), F.col("signal")).otherwise(0))

    tried = backtest.equity_stats(backtest.simulate(signals("train"), keyed), keyed)
    score = F.when(F.first("ok"), F.round(score_of(spec.optimize_for), 10)).alias("score")
    scores = tried.groupBy(*SLICE, "run").agg(score)
    # NULL scores sort last: no score counts as the largest negative.
    order = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))), F.col("run"))
    best = scores.groupBy(*SLICE).agg(F.min_by(F.struct("run", "score"), order).alias("_best"))
    chosen = signals("test").join(best, list(SLICE)).filter(F.col("run") == F.col("_best.run"))
    chosen = chosen.withColumn("train_score", F.col("_best.score")).drop("_best")
    return backtest.equity_stats(backtest.simulate(chosen, keyed), keyed).drop("phase", "n_rows")


def results(bars: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """One row per symbol and window."""
    combos = spec.combos
    rep = backtest.report(
        evaluate(bars, spec),
        [*SLICE, "start", "run", "train_score", "ok"],
        False,
        ["total_return", "sharpe_ratio", "max_drawdown"],
    )
    rep = rep.withColumns(bounds(F.col("start"), F.col("win") - 1, spec))
    return search.describe(rep, spec.strategy, combos).select(
        *SLICE,
        "train_start", "train_end", "test_start", "test_end",
        F.col("params").alias("best_params"),
        F.round("train_score", 3).alias("train_sharpe"),
        F.round("sharpe_ratio", 3).alias("test_sharpe"),
        F.round("total_return", 4).alias("test_return"),
        F.round("max_drawdown", 4).alias("test_max_drawdown"),
        F.col("n_trades").alias("test_n_trades"),
        F.when(F.col("ok"), "ok").otherwise("short test slice").alias("status"),
    )


def stitched_rows(sim: DataFrame) -> DataFrame:
    """Add ``stitched``: test curves joined end to end, each starting where the one before
    ended.

    The scale of a window is the product of the growth of all earlier windows, one running
    sum of logs per symbol. It is NULL on the repeated first point of later windows, and on
    slices without a run, which add no points.
    """
    per_win = Window.partitionBy(*SLICE).orderBy(INDEX)
    whole = per_win.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = sim.withColumns(
        {
            "_first": F.first("equity").over(whole),
            "_last": F.last("equity").over(whole),
            "_tail": F.max(INDEX).over(whole),
        }
    )
    growth = F.when(
        (F.col(INDEX) == F.col("_tail")) & (F.col("_first") > 0), F.ln(F.col("_last") / F.col("_first"))
    )
    line = Window.partitionBy("symbol").orderBy("win", INDEX)
    d = d.withColumns(
        {
            "_log": F.coalesce(
                F.sum(growth).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
            ),
            "_base": F.first("_first").over(line.rowsBetween(Window.unboundedPreceding, 0)),
            "_at": F.row_number().over(line),
        }
    )
    value = F.col("equity") / F.col("_first") * F.col("_base") * F.exp("_log")
    kept = (F.col("_at") == 1) | (F.col("ok") & (F.col(INDEX) > 0)) | (
        F.col("ok") & (F.col("_at") == F.col(INDEX) + 1)
    )
    return d.withColumn("stitched", F.when(kept, value)).drop(
        "_first", "_last", "_tail", "_log", "_base", "_at"
    )


def stitch(sim: DataFrame) -> DataFrame:
    """The combined curve, one row per kept point."""
    rows = stitched_rows(sim).filter(F.col("stitched").isNotNull())
    return rows.select("symbol", "win", INDEX, "ts", "stitched")


def summary(bars: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Means over windows, robustness ratio, verdict and the stitched curve's outcome.

    One pass over the simulated rows: bars to windows, then windows to symbols.
    """
    line = Window.partitionBy("symbol").orderBy("win", INDEX)
    rows = stitched_rows(evaluate(bars, spec)).withColumn(
        "_peak", F.max("stitched").over(line.rowsBetween(Window.unboundedPreceding, 0))
    )
    seen = F.when(F.col("stitched").isNotNull(), F.col(INDEX))
    wins = rows.groupBy(*SLICE, "train_score").agg(
        metrics.sharpe("ret").alias("_sharpe"),
        F.min_by("stitched", seen).alias("_open"),
        F.max_by("stitched", seen).alias("_close"),
        F.max((F.col("_peak") - F.col("stitched")) / F.col("_peak")).alias("_fall"),
    )
    has = F.when(F.col("_close").isNotNull(), F.col("win"))
    means = wins.groupBy("symbol").agg(
        F.avg(F.round("train_score", 3)).alias("_in"),
        F.avg(F.round("_sharpe", 3)).alias("_out"),
        F.count(F.lit(1)).alias("n_windows"),
        (F.max_by("_close", has) / F.min_by("_open", has) - 1).alias("_return"),
        F.max("_fall").alias("_mdd"),
    )
    ratio = F.when(F.abs("_in") < 0.01, 0.0).otherwise(F.col("_out") / F.col("_in"))
    verdict = (
        F.when(F.col("_ratio") >= ROBUST, "ROBUST")
        .when(F.col("_ratio") >= MODERATE, "MODERATE")
        .otherwise("OVERFITTED")
    )
    return means.withColumn("_ratio", ratio).select(
        "symbol",
        F.round("_in", 3).alias("in_sample_sharpe"),
        F.round("_out", 3).alias("out_of_sample_sharpe"),
        F.round("_ratio", 3).alias("robustness_ratio"),
        verdict.alias("verdict"),
        "n_windows",
        F.round("_return", 4).alias("combined_return"),
        F.round("_mdd", 4).alias("combined_max_drawdown"),
    )
