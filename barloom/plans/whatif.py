"""What-if scenarios: a question per symbol, answered from history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import ranges
from barloom.operators.series import INDEX, Layout, index_rows
from barloom.operators.validation import bars_needed
from barloom.plans import backtest

# Words that announce a move, named periods and the default period.
FALL_WORDS = "drop|fall|decline|crash|down"
RISE_WORDS = "rise|gain|up|rally|jump|increase"
PERIODS = {
    "covid": ("2020-02-01", "2020-04-30"),
    "2022_bear": ("2022-01-01", "2022-12-31"),
    "2008": ("2008-09-01", "2009-03-31"),
}
DEFAULT_PERIOD = ("2022-01-01", "2024-12-31")
DEFAULT_SHOCK = -10.0
PERIOD_SHOCK = -5.0
MOVE = 0.05
BASE_SHARPE = 0.5
RECOVERY_BARS = 90
YEARS = 5


def detect(question: Column) -> dict[str, Column]:
    """Scenario kind, shock in percent and named period read from a question."""
    q = F.lower(question)
    number = r"\s+(\d+(?:\.\d+)?)\s*%"
    fall = F.regexp_extract(q, f"({FALL_WORDS}){number}", 2)
    rise = F.regexp_extract(q, f"({RISE_WORDS}){number}", 2)
    has = q.contains
    period = (
        F.when(has("covid") | has("pandemic"), "covid")
        .when(has("2022") & (has("bear") | has("crash")), "2022_bear")
        .when(has("2008") | has("financial crisis"), "2008")
    )
    shock = F.when(fall != "", -fall.try_cast("double")).when(rise != "", rise.try_cast("double"))
    return {
        "period": F.when(shock.isNull(), period),
        "shock": F.coalesce(shock, F.when(period.isNull(), F.lit(DEFAULT_SHOCK))),
    }


def shock_recovery(bars: DataFrame, shocks: DataFrame) -> DataFrame:
    """Bars that moved beyond each threshold, and mean bars until the price was back.

    ``shocks(symbol, threshold)`` holds fractions. Bars are packed into blocks once; only those
    beyond a threshold look ahead, at the blocks of the next 88 bars whose highest or lowest
    close reaches the old price.
    """
    prev = F.lag("close").over(Window.partitionBy("symbol").orderBy(INDEX))
    stored = ranges.blocks(bars.withColumn("_pre", prev), "close", "close", "_pre")
    rows = stored.select("symbol", "blk", F.posexplode(F.arrays_zip(F.col("hi").alias("close"), F.col("values").alias("pre"))).alias("i", "bar"))
    moves = rows.select(
        "symbol",
        (F.col("blk") * ranges.BLOCK_ROWS + F.col("i")).alias(INDEX),
        F.col("bar.pre").alias("level"),
        (F.col("bar.close") / F.col("bar.pre") - 1).alias("_move"),
    )
    hit = F.when(F.col("threshold") < 0, F.col("_move") < F.col("threshold")).otherwise(
        F.col("_move") > F.col("threshold")
    )
    hits = shocks.distinct().join(moves, "symbol").filter(hit).withColumn("up", F.col("threshold") < 0)
    hits = ranges.first_reach(stored, hits, RECOVERY_BARS - 2)
    per = hits.select("symbol", "threshold", (F.col("after") + 1).alias("_days"))
    counts = per.groupBy("symbol", "threshold").agg(
        F.count(F.lit(1)).alias("occurrences"), F.avg("_days").alias("avg_recovery")
    )
    return (
        shocks.distinct()
        .join(counts, ["symbol", "threshold"], "left")
        .select(
            "symbol",
            "threshold",
            F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
            F.coalesce("avg_recovery", F.lit(0.0)).alias("avg_recovery"),
        )
    )


def period_backtests(
    bars: DataFrame, periods: dict[str, tuple[str, str]], strategy: str
) -> DataFrame:
    """One back-test per symbol and named period, end dates excluded."""
    day = F.to_date("ts")
    inside = F.array_compact(
        F.array(
            *[
                F.when((day >= F.lit(a).cast("date")) & (day < F.lit(b).cast("date")), F.lit(name))
                for name, (a, b) in periods.items()
            ]
        )
    )
    layout = Layout(("symbol", "period"))
    rows = index_rows(bars.withColumn("period", F.explode(inside)), layout)
    n = F.count(F.lit(1)).over(Window.partitionBy(*layout.keys))
    rows = rows.withColumn("_n", n).filter(F.col("_n") >= bars_needed(strategy, {}))
    rep = backtest.run(rows, strategy, None, layout, rounded=False)
    return rep.select("symbol", "period", "sharpe_ratio", "total_return")


def text(fmt: str, *args) -> Column:
    return F.format_string(fmt, *args)


def what_if(
    bars: DataFrame,
    questions: DataFrame,
    strategy: str = "momentum",
    periods: dict | None = None,
    default_period: tuple[str, str] = DEFAULT_PERIOD,
    current_signal: str = "HOLD",
    current_sharpe: float = BASE_SHARPE,
) -> DataFrame:
    """Answers for ``questions(symbol, question)`` from daily ``bars``."""
    periods = dict(periods or PERIODS, default=default_period)
    bars = bars.select("symbol", "ts", "open", "close")
    found = detect(F.col("question"))
    q = questions.withColumns(found).withColumn("_run", F.coalesce("period", F.lit("default")))
    q = q.withColumn("threshold", F.coalesce("shock", F.lit(PERIOD_SHOCK)) / 100)
    top = F.max("ts").over(Window.partitionBy("symbol"))
    recent = index_rows(
        bars.withColumn("_top", top).filter(
            F.col("ts") > F.col("_top") - F.expr(f"INTERVAL {YEARS} YEARS")
        ),
        Layout(),
    )
    runs = period_backtests(bars, periods, strategy).withColumnRenamed("period", "_run")
    out = q.join(runs, ["symbol", "_run"], "left").join(
        shock_recovery(recent, q.select("symbol", "threshold")), ["symbol", "threshold"], "left"
    )
    ret, sharpe = F.coalesce("total_return", F.lit(0.0)), F.coalesce("sharpe_ratio", F.lit(0.0))
    new = F.when(ret > MOVE, "BUY").when(ret < -MOVE, "SELL").otherwise("HOLD")
    starts = F.create_map(*[F.lit(x) for n, (a, _) in periods.items() for x in (n, a)])
    ends = F.create_map(*[F.lit(x) for n, (_, b) in periods.items() for x in (n, b)])
    by_period = F.col("period").isNotNull()
    described = F.when(
        by_period,
        text("%s during %s to %s", "symbol", starts[F.col("_run")], ends[F.col("_run")]),
    ).otherwise(
        text("%+.1f%% price %s in %s", "shock", F.when(F.col("shock") < 0, "drop").otherwise("rise"),
             "symbol")
    )
    out = out.withColumns(
        {
            "new_signal": new,
            "new_sharpe": sharpe,
            "price_impact": F.coalesce("shock", ret * 100),
            "historical_occurrences": F.coalesce("occurrences", F.lit(0)),
            "_days": F.coalesce("avg_recovery", F.lit(0.0)),
            "scenario_description": described,
        }
    )
    seen, days = F.col("historical_occurrences"), F.col("_days")
    signal_text = F.when(
        F.col("new_signal") != current_signal,
        text(f"signal changes from {current_signal} to %s", "new_signal"),
    ).otherwise(text("signal remains %s", "new_signal"))
    explanation = F.trim(
        F.concat(
            text(f"Under this scenario, the {strategy} strategy %s. Price impact: %+.1f%%, "
                 "Sharpe: %.2f. ", signal_text, "price_impact", "new_sharpe"),
            F.when(seen > 0, text("This occurred %d times in 5 years.", seen)).otherwise(""),
            F.lit(" "),
            F.when(days > 0, text("Historically recovered in ~%.0f days.", days)).otherwise(""),
        )
    )
    return out.select(
        "symbol",
        "question",
        F.when(by_period, "historical_period").otherwise("price_shock").alias("scenario_type"),
        "scenario_description",
        F.when(
            F.col("new_signal") != current_signal, F.concat(F.lit(f"{current_signal} -> "), "new_signal")
        ).alias("signal_change"),
        "new_signal",
        F.round("price_impact", 2).alias("price_impact"),
        F.round(F.col("new_sharpe") - current_sharpe, 3).alias("sharpe_impact"),
        F.round("new_sharpe", 3).alias("new_sharpe"),
        "historical_occurrences",
        F.when(days > 0, F.round(days, 1)).alias("avg_recovery_days"),
        explanation.alias("explanation"),
    )
