"""From market features, text and back-tests to a recommendation per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import retrieval, rolling
from barloom.operators import signals as sig
from barloom.operators.quotes import at, newest
from barloom.operators.series import BY_SYMBOL, INDEX, Layout, index_rows
from barloom.plans import backtest

# Fixed value: longest summary line of a comparison.
SUMMARY_CHARS = 100
# Fixed value: longest context of retrieved passages.
SOURCE_CHARS = 6000


def regime_features(bars: DataFrame) -> DataFrame:
    """Volatility, slope of the 20-bar average and last change from one year of bars."""
    hist = newest(bars.withColumn("close", F.round("close", 2)), 252)
    w = Window.partitionBy("symbol").orderBy("ts")
    hist = hist.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    rn = F.col("rn")
    now = F.avg(F.when(rn <= 20, F.col("close")))
    then = F.avg(F.when(rn.between(5, 24), F.col("close")))
    return hist.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.when(
            F.count("ret") >= 20, F.stddev_samp(F.when(rn <= 20, F.col("ret")))
        ).otherwise(0.02).alias("volatility"),
        F.when(then > 0, (now - then) / (then * 5)).otherwise(0.0).alias("slope"),
        F.round((at(1, "close") / at(2, "close") - 1) * 100, 2).alias("change_pct"),
    )


# Words counted as market tone, and the limits of the strategy choice.
BULLISH = ["growth", "record", "beat", "strong", "increase", "rose"]
BEARISH = ["decline", "fell", "miss", "weak", "decrease", "dropped"]
TREND, STRONG_TREND, SLOPE, VOLATILE, TONE, TONE_WORDS = 5.0, 8.0, 0.001, 0.025, 0.2, 2
MIN_BARS = 50
WIDE_Z, TIGHT_Z = 2.5, 1.5

# The risk limits, score weights and retry count.
MIN_SHARPE, MAX_MDD, MAX_VAR, MIN_WIN, MIN_TRADES = 0.5, 0.25, 0.05, 0.30, 5
MAX_RETRIES = 3

STRATEGIES = ["momentum", "mean_reversion", "rsi", "macd"]


def state(features: DataFrame, evidence: DataFrame) -> DataFrame:
    """All inputs of the choice in one row per symbol; missing text counts as neutral.

    ``evidence``: ``symbol, sentiment_score, sentiment_label, bullish_words, bearish_words``.
    """
    return features.join(evidence, "symbol", "left").fillna(
        {"sentiment_score": 0.0, "sentiment_label": "NEUTRAL", "bullish_words": 0, "bearish_words": 0}
    )


def choose(rows: DataFrame) -> DataFrame:
    """Strategy per symbol from trend, volatility, sentiment and tone."""
    trend, vol, mood = F.abs("change_pct"), F.col("volatility"), F.col("sentiment_score")
    trending = (trend > TREND) | (F.abs("slope") > SLOPE)
    strong, wild = trend > STRONG_TREND, vol > VOLATILE
    confirmed = (strong | (mood > TONE)) & (F.col("bullish_words") >= TONE_WORDS)
    pick = (
        F.when(F.col("n_bars") < MIN_BARS, "momentum")
        .when(trending & ~wild & confirmed, "macd")
        .when(trending & ~wild & (mood < -TONE) & ~strong, "mean_reversion")
        .when(trending & ~wild, "momentum")
        .when(wild, "mean_reversion")
        .otherwise("rsi")
    )
    return rows.withColumns(
        {"strategy": pick, "z_threshold": F.when(wild, WIDE_Z).otherwise(TIGHT_Z)}
    )


# The back-tests any symbol may need: reversion with both entry levels.
RUNS = ["momentum", "mean_reversion_1.5", "mean_reversion_2.5", "rsi", "macd"]


def run_name(strategy: Column, z_threshold: Column) -> Column:
    wide = F.when(z_threshold == WIDE_Z, RUNS[2]).otherwise(RUNS[1])
    return F.when(strategy == "mean_reversion", wide).otherwise(strategy)


def strategy_reports(bars: DataFrame) -> DataFrame:
    """Reports of every run per symbol over one placement of the bars.

    The signals of all runs become columns of the same rows, which are then unpivoted and
    simulated. It needs nothing but the bars, so the choice is never computed twice.
    """
    d = index_rows(bars.select("symbol", "ts", "open", "close"), BY_SYMBOL).drop("ts")
    d = sig.momentum(d).withColumnRenamed("signal", "_momentum").drop("ma_short", "ma_long")
    size = sig.DEFAULTS["mean_reversion"]["window"]
    d = rolling.zscore(d, size)
    for name, limit in ((RUNS[1], TIGHT_Z), (RUNS[2], WIDE_Z)):
        d = sig.reversion_signals(d, size, limit, 0.0, BY_SYMBOL)
        d = d.withColumnRenamed("signal", "_" + name)
    d = sig.rsi_levels(d.drop("z")).withColumnRenamed("signal", "_rsi").drop("rsi")
    d = sig.macd_cross(d).withColumnRenamed("signal", "_macd").drop("macd", "macd_signal", "hist")
    runs = F.array(
        *[F.struct(F.lit(s).alias("run"), F.col(f"`_{s}`").alias("signal")) for s in RUNS]
    )
    rows = d.select("symbol", INDEX, "open", "close", F.inline(runs))
    keyed = Layout(("symbol", "run"))
    sim = backtest.equity_stats(backtest.simulate(rows, keyed), keyed)
    return backtest.report(sim, ["symbol", "run"])


def percent(c, digits: int):
    return F.format_string(f"%.{digits}f%%", F.col(c) * 100)


def risk_gate(reports: DataFrame) -> DataFrame:
    """Score 0 (safe) to 10, level, and the limits a report breaks."""
    sharpe, mdd = F.col("sharpe_ratio"), F.col("max_drawdown")
    var, win = F.col("var_95"), F.col("win_rate")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(10.0), c))
    score = (
        0.30 * clamp((2.0 - sharpe) * 5)
        + 0.40 * F.least(F.lit(10.0), mdd * 40)
        + 0.20 * F.least(F.lit(10.0), var * 200)
        + 0.10 * clamp((0.5 - win) * 20)
    )
    reasons = F.array_compact(
        F.array(
            F.when(sharpe < MIN_SHARPE, F.format_string("Sharpe %.2f < 0.5 minimum", sharpe)),
            F.when(
                mdd > MAX_MDD,
                F.concat(F.lit("Max drawdown "), percent("max_drawdown", 1), F.lit(" > 25% limit")),
            ),
            F.when(
                var > MAX_VAR, F.concat(F.lit("VaR 95% "), percent("var_95", 2), F.lit(" > 5% limit"))
            ),
            F.when(
                (win < MIN_WIN) & (F.col("n_trades") > MIN_TRADES),
                F.concat(F.lit("Win rate "), percent("win_rate", 1), F.lit(" < 30% minimum")),
            ),
        )
    )
    d = reports.withColumns({"_score": score, "_reasons": reasons})
    level = F.when(F.col("_score") < 3, "LOW").when(F.col("_score") < 6, "MEDIUM").otherwise("HIGH")
    return d.withColumns(
        {
            "risk_score": F.round("_score", 2),
            "risk_level": level,
            "risk_approved": F.size("_reasons") == 0,
            "rejection_reason": F.array_join("_reasons", "; "),
        }
    ).drop("_score", "_reasons")


def attempts(chosen: DataFrame) -> DataFrame:
    """The first choice and up to three alternatives per symbol, in the order tried."""
    other = lambda s: F.when(s == "mean_reversion", "momentum").otherwise("mean_reversion")
    tried = [F.col("strategy")]
    for _ in range(MAX_RETRIES):
        tried.append(other(tried[-1]))
    order = F.array(
        *[F.struct(F.lit(i).alias("attempt"), s.alias("strategy")) for i, s in enumerate(tried)]
    )
    d = chosen.select(*[c for c in chosen.columns if c != "strategy"], F.inline(order))
    return d.withColumn("run", run_name(F.col("strategy"), F.col("z_threshold")))


def resolve(chosen: DataFrame, gated: DataFrame) -> DataFrame:
    """First attempt that passes the gate; after the last retry it is approved with a note."""
    tries = attempts(chosen).join(gated, ["symbol", "run"])
    ok = F.col("risk_approved") | (F.col("attempt") == MAX_RETRIES)
    kept = [c for c in tries.columns if c != "symbol"]
    best = tries.groupBy("symbol").agg(
        F.min_by(F.struct(*kept), F.when(ok, F.col("attempt"))).alias("_r")
    )
    d = best.select("symbol", "_r.*").withColumnRenamed("attempt", "retries")
    note = F.concat(
        F.lit(f"Approved after {MAX_RETRIES} retries (best available). Violations: "),
        F.col("rejection_reason"),
    )
    return d.withColumns(
        {
            "rejection_reason": F.when(~F.col("risk_approved"), note).otherwise(""),
            "risk_approved": F.lit(True),
        }
    )


# The limits and the texts of an explanation.
def recommend(rows: DataFrame) -> DataFrame:
    """BUY, SELL or HOLD from the report, with a templated explanation."""
    sharpe, ret = F.col("sharpe_ratio"), F.col("total_return")
    signal = (
        F.when((sharpe > 1.0) & (ret > 0.05), "BUY")
        .when((sharpe < 0.0) | (ret < -0.10), "SELL")
        .otherwise("HOLD")
    )
    d = rows.withColumn("recommendation", signal)
    s = F.col("recommendation")
    mood = F.when(s == "BUY", "shows positive momentum").otherwise("indicates caution")
    verdict = (
        F.when(s == "BUY", "Strong risk-adjusted returns support a BUY recommendation.")
        .when(s == "HOLD", "Risk metrics suggest caution — consider HOLD or reduced position.")
        .otherwise("Negative performance metrics suggest avoiding this position.")
    )
    cited = F.col("citations") if "citations" in rows.columns else F.array().cast("array<string>")
    first = F.slice(cited, 1, 3)
    sources = F.when(F.size(first) == 0, "No sources available.").otherwise(
        F.array_join(
            F.transform(first, lambda c, i: F.concat(F.lit("["), i + 1, F.lit("] "), c)), "\n"
        )
    )
    text = F.format_string(
        "SIGNAL: %s\nCONFIDENCE: MEDIUM\n\n%s analysis using %s strategy:\n\n"
        "Quantitative Evidence:\n- Total Return: %s over backtest period\n"
        "- Sharpe Ratio: %.2f (risk-adjusted performance)\n- Maximum Drawdown: %s\n"
        "- Risk Level: %s\n\nThe %s strategy %s for %s.\n%s\n\nSOURCES:\n%s",
        s, "symbol", F.upper("strategy"), percent("total_return", 1), "sharpe_ratio",
        percent("max_drawdown", 1), "risk_level", "strategy", mood, "symbol", verdict, sources,
    )
    return d.withColumn("explanation", text)


def sources_of(questions: DataFrame, chunks: DataFrame, n: int = retrieval.N_RESULTS, chars: int = SOURCE_CHARS) -> DataFrame:
    """``(symbol, citations, context)``: what is known about each symbol, for its advice.

    ``questions(symbol, query_id, query)`` search the chunks of their own symbol
    ``(vec_id, symbol, vector, content, citation)``; of the nearest the ``n`` picks that repeat each other
    least are cited in their order. A symbol without chunks has no row.
    """
    near = retrieval.filtered_topk(chunks, questions, "symbol", retrieval.fetch_size(n))
    texts = chunks.select("vec_id", "content", "citation")
    picks = retrieval.mmr(near.join(texts, "vec_id"), n).join(texts, "vec_id")
    listed = F.sort_array(F.collect_list(F.struct("position", "citation")))["citation"]
    cited = picks.groupBy("query_id").agg(listed.alias("citations"))
    told = retrieval.build_context(picks, chars).select("query_id", "context")
    return questions.select("symbol", "query_id").join(cited, "query_id").join(told, "query_id").drop("query_id")


def composite(rows: DataFrame) -> DataFrame:
    """Weighted score of a report; a missing report scores 0."""
    unit = lambda c, top: F.when(F.col(c) > 0, F.least(F.col(c) / top, F.lit(1.0))).otherwise(0.0)
    score = (
        0.40 * unit("sharpe_ratio", 3.0)
        + 0.30 * unit("total_return", 2.0)
        + 0.20 * (1.0 - F.least(F.col("max_drawdown"), F.lit(1.0)))
        + 0.10 * F.col("win_rate")
    )
    return rows.withColumn("composite_score", F.coalesce(F.round(score, 4), F.lit(0.0)))


def compare(rows: DataFrame, request: str, position: str) -> DataFrame:
    """Rank within each request by composite score; equal scores keep the given order.

    A request names at most ten symbols, which bounds its group.
    """
    w = Window.partitionBy(request).orderBy(F.col("composite_score").desc(), position)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return composite(rows).withColumns(
        {
            "rank": F.row_number().over(w),
            "best_ticker": F.first("symbol").over(whole),
            "worst_ticker": F.last("symbol").over(whole),
        }
    )


def compare_analyses(
    asked: DataFrame, analyses: DataFrame, request: str, position: str, summary_chars: int | None = SUMMARY_CHARS
) -> DataFrame:
    """Whole analyses ranked within each request, with signal, strategy and a summary line.

    ``asked`` names (request, position, symbol). A symbol without an analysis stays in its
    request with score 0, a HOLD and the reason as its summary.
    """
    lines = F.filter(F.split("explanation", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("SIGNAL"))
    made, line = F.col("recommendation").isNotNull(), F.element_at(lines, 1)
    rows = asked.join(analyses, "symbol", "left").select(
        request,
        position,
        "symbol",
        F.coalesce("recommendation", F.lit("HOLD")).alias("signal"),
        F.coalesce("strategy", F.lit("unknown")).alias("strategy"),
        F.when(made, line if summary_chars is None else F.substring(line, 1, summary_chars))
        .otherwise("Analysis failed: no data").alias("summary"),
        "sharpe_ratio", "total_return", "max_drawdown", "win_rate",
    )
    return compare(rows, request, position)


def analyze(bars: DataFrame, evidence: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Whole analysis of every symbol: choice, back-tests, risk gate, retries, retrieved sources, advice."""
    chosen = choose(state(regime_features(bars), evidence))
    rows = resolve(chosen, risk_gate(strategy_reports(bars)))
    if sources is not None:
        none = F.concat(F.lit("No financial documents found for "), "symbol", F.lit("."))
        rows = rows.join(sources, "symbol", "left").withColumns(
            {"citations": F.coalesce("citations", F.array().cast("array<string>")), "context": F.coalesce("context", none)}
        )
    return recommend(rows)
