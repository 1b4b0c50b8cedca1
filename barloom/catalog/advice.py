"""Strategy choice, risk gate, retries, recommendation and the whole analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.book import exact
from barloom.catalog.registry import query
from barloom.catalog.rolling import SQL_REGIME, SQL_ZS
from barloom.catalog.text import BAD, GOOD, SQL_SCORED, SQL_WORDS, citation_of, sql_list, sql_mmr, sql_sentiment
from barloom.catalog.trend import (
    SQL_MACD_RULE, SQL_MACD_WALK, SQL_RSI_RULE, SQL_RSI_WALK, sql_reversion,
)
from barloom.catalog.views import (
    SQL_DAILY, SQL_REPORT_FIELDS, daily, prose, sql_backtest, sql_momentum, sql_report, with_sql,
)
from barloom.operators import retrieval, sentiment
from barloom.plans import decision
from barloom.sources.bars import table

# Frequent words of the supplied prose join the tone lists.
BULL = decision.BULLISH + ["these", "cheval"]
BEAR = decision.BEARISH + ["those", "unter"]


def symbol_of(source):
    """Documents of source ``srcK`` belong to brand K."""
    return F.concat(F.lit("Brand#"), F.substring(source, 4, 10))


def symbol_evidence(spark, d):
    words = {"bullish_words": BULL, "bearish_words": BEAR}
    return sentiment.evidence(
        prose(spark, d), symbol_of(F.col("source")), "text", words, GOOD, BAD
    )


def chosen(spark, d):
    return decision.choose(
        decision.state(decision.regime_features(daily(spark, d)), symbol_evidence(spark, d))
    )


SQL_STATE = f"""
{SQL_SCORED.strip()},
bysym AS (SELECT 'Brand#' || substring(source, 4) AS symbol, score, confidence FROM scored),
{sql_sentiment("symbol").replace("FROM scored", "FROM bysym").strip()},
tonew AS (
  SELECT 'Brand#' || substring(source, 4) AS symbol, w, max(contains(lower(text), w)::INT) AS hit
  FROM documents CROSS JOIN (SELECT unnest({sql_list(BULL + BEAR)}) AS w) GROUP BY ALL),
tone AS (
  SELECT symbol, sum(hit) FILTER (WHERE w IN ({sql_list(BULL)[1:-1]})) AS bullish_words,
    sum(hit) FILTER (WHERE w IN ({sql_list(BEAR)[1:-1]})) AS bearish_words FROM tonew GROUP BY symbol),
state AS (
  SELECT r.*, coalesce(sentiment_score, 0) AS sentiment_score,
    coalesce(sentiment_label, 'NEUTRAL') AS sentiment_label, coalesce(bullish_words, 0) AS bullish_words,
    coalesce(bearish_words, 0) AS bearish_words
  FROM regime r LEFT JOIN sent USING (symbol) LEFT JOIN tone USING (symbol)),
flags AS (
  SELECT *, abs(change_pct) > 5 OR abs(slope) > 0.001 AS trending, abs(change_pct) > 8 AS strong,
    volatility > 0.025 AS wild FROM state),
chosen AS (
  SELECT *, CASE WHEN n_bars < 50 THEN 'momentum'
    WHEN trending AND NOT wild AND (strong OR sentiment_score > 0.2) AND bullish_words >= 2 THEN 'macd'
    WHEN trending AND NOT wild AND sentiment_score < -0.2 AND NOT strong THEN 'mean_reversion'
    WHEN trending AND NOT wild THEN 'momentum' WHEN wild THEN 'mean_reversion' ELSE 'rsi' END AS strategy,
    CASE WHEN wild THEN 2.5 ELSE 1.5 END::DOUBLE AS z_threshold FROM flags)"""


@query(
    "strategy_select",
    with_sql(SQL_DAILY, SQL_REGIME, SQL_STATE)
    + """SELECT symbol, n_bars, round(volatility, 6) AS volatility, round(slope, 8) AS slope, change_pct,
  round(sentiment_score, 6)::DOUBLE AS sentiment_score, sentiment_label,
  bullish_words::INT AS bullish_words, bearish_words::INT AS bearish_words, strategy, z_threshold
FROM chosen""",
)
def strategy_select(spark, d):
    return chosen(spark, d).select(
        "symbol", "n_bars",
        F.round("volatility", 6).alias("volatility"),
        F.round("slope", 8).alias("slope"),
        "change_pct",
        F.round("sentiment_score", 6).alias("sentiment_score"),
        "sentiment_label",
        F.col("bullish_words").cast("int").alias("bullish_words"),
        F.col("bearish_words").cast("int").alias("bearish_words"),
        "strategy", "z_threshold",
    )


SQL_RUNS = ",".join(
    x.strip()
    for x in (
        sql_momentum("daily", 20, 50, out="mo"),
        SQL_ZS,
        sql_reversion(1.5, name="auto15"),
        sql_reversion(2.5, name="auto25"),
        SQL_RSI_WALK,
        SQL_RSI_RULE,
        SQL_MACD_WALK,
        SQL_MACD_RULE,
        """
runs AS (
  SELECT symbol, idx, 'momentum' AS run, signal FROM mo
  UNION ALL SELECT symbol, i - 1, 'mean_reversion_1.5', signal FROM auto15
  UNION ALL SELECT symbol, i - 1, 'mean_reversion_2.5', signal FROM auto25
  UNION ALL SELECT symbol, idx, 'rsi', signal FROM rs
  UNION ALL SELECT symbol, idx, 'macd', signal FROM ms),
rund AS (SELECT d.symbol, run, d.idx, ts, open, close, signal FROM daily d JOIN runs USING (symbol, idx))""",
        sql_backtest("rund", "symbol, run", "rsim"),
        sql_report("rsim", "symbol, run", "rrep"),
        f"""
rounded AS (SELECT symbol, run, {SQL_REPORT_FIELDS} FROM rrep),
gate0 AS (
  SELECT *, 0.30 * greatest(0, least(10, (2.0 - sharpe_ratio) * 5)) + 0.40 * least(10, max_drawdown * 40)
      + 0.20 * least(10, var_95 * 200) + 0.10 * greatest(0, least(10, (0.5 - win_rate) * 20)) AS score,
    concat_ws('; ',
      CASE WHEN sharpe_ratio < 0.5 THEN printf('Sharpe %.2f < 0.5 minimum', {exact('sharpe_ratio', 2)}) END,
      CASE WHEN max_drawdown > 0.25 THEN printf('Max drawdown %.1f%% > 25%% limit', {exact('max_drawdown * 100', 1)}) END,
      CASE WHEN var_95 > 0.05 THEN printf('VaR 95%% %.2f%% > 5%% limit', {exact('var_95 * 100', 2)}) END,
      CASE WHEN win_rate < 0.30 AND n_trades > 5
           THEN printf('Win rate %.1f%% < 30%% minimum', {exact('win_rate * 100', 1)}) END) AS reasons
  FROM rounded),
gate AS (
  SELECT *, round(score, 2)::DOUBLE AS risk_score, CASE WHEN score < 3 THEN 'LOW' WHEN score < 6
    THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level, reasons = '' AS risk_approved FROM gate0)""",
    )
)


@query(
    "risk_gate",
    with_sql(SQL_DAILY, SQL_RUNS)
    + """SELECT symbol, run, sharpe_ratio, max_drawdown, var_95, win_rate, n_trades, risk_score,
  risk_level, risk_approved, reasons AS rejection_reason FROM gate""",
)
def risk_gate(spark, d):
    gated = decision.risk_gate(decision.strategy_reports(daily(spark, d)))
    return gated.select(
        "symbol", "run", "sharpe_ratio", "max_drawdown", "var_95", "win_rate", "n_trades",
        "risk_score", "risk_level", "risk_approved", "rejection_reason",
    )


SQL_RESOLVED = """
tries AS (
  SELECT symbol, attempt, CASE WHEN attempt = 0 THEN strategy
    WHEN (attempt % 2 = 1) = (strategy <> 'mean_reversion') THEN 'mean_reversion' ELSE 'momentum' END
    AS strategy
  FROM chosen CROSS JOIN (VALUES (0), (1), (2), (3)) v(attempt)),
resolved AS (
  SELECT * REPLACE (CASE WHEN risk_approved THEN '' ELSE
      'Approved after 3 retries (best available). Violations: ' || reasons END AS reasons)
  FROM (SELECT symbol, attempt, t.strategy, CASE WHEN t.strategy <> 'mean_reversion' THEN t.strategy
          WHEN z_threshold = 2.5 THEN 'mean_reversion_2.5' ELSE 'mean_reversion_1.5' END AS run
        FROM tries t JOIN chosen c USING (symbol))
  JOIN gate USING (symbol, run) WHERE risk_approved OR attempt = 3
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY attempt) = 1)"""


@query(
    "retry_resolve",
    with_sql(SQL_DAILY, SQL_REGIME, SQL_STATE, SQL_RUNS, SQL_RESOLVED)
    + """SELECT symbol, strategy, attempt::INT AS retries, risk_score, reasons AS rejection_reason,
  sharpe_ratio, total_return FROM resolved""",
)
def retry_resolve(spark, d):
    gated = decision.risk_gate(decision.strategy_reports(daily(spark, d)))
    return decision.resolve(chosen(spark, d), gated).select(
        "symbol", "strategy", "retries", "risk_score", "rejection_reason", "sharpe_ratio",
        "total_return",
    )


SQL_ADVICE = """
adv AS (
  SELECT r.*, c.sentiment_score, c.sentiment_label, c.change_pct, c.volatility,
    CASE WHEN sharpe_ratio > 1 AND total_return > 0.05 THEN 'BUY'
         WHEN sharpe_ratio < 0 OR total_return < -0.10 THEN 'SELL' ELSE 'HOLD' END AS recommendation
  FROM resolved r JOIN chosen c ON c.symbol = r.symbol)"""


def symbol_sources(spark, d):
    """What each brand's documents say: its question is the mean vector of a label."""
    docs = prose(spark, d)
    v = table(spark, d, "embeddings")
    means = retrieval.centroids(v, "label", "embedding").withColumnRenamed("query_id", "label")
    number = F.substring("source", 4, 10).cast("long")
    asked = docs.select(symbol_of(F.col("source")).alias("symbol"), number.alias("query_id")).distinct()
    questions = asked.withColumn("label", F.col("query_id") % 10).join(means, "label").select("symbol", "query_id", "query")
    chunks = docs.join(v, F.col("doc_id") == F.col("vec_id")).select(
        "vec_id", F.col("embedding").alias("vector"), symbol_of(F.col("source")).alias("symbol"),
        F.col("text").alias("content"), citation_of(F.col("doc_id")).alias("citation"),
    )
    return decision.sources_of(questions, chunks)


def full_analysis(spark, d):
    return decision.analyze(daily(spark, d), symbol_evidence(spark, d), symbol_sources(spark, d))


SQL_PICKS = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, 6))
SQL_SOURCES = f"""
ex AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
mean AS (SELECT label, i, avg(v) AS m FROM ex GROUP BY label, i),
qv AS (SELECT label, list(m ORDER BY i) AS q FROM mean GROUP BY label),
sq AS (SELECT DISTINCT source, substring(source, 4)::BIGINT AS query_id FROM documents),
scs AS (
  SELECT sq.query_id, vec_id, text AS content, source, doc_id, list_distinct({SQL_WORDS.format('lower(text)')}) AS ws,
    1 - (1 - list_cosine_similarity(embedding::DOUBLE[], q)) / 2 AS score
  FROM sq JOIN qv ON label = query_id % 10 JOIN documents USING (source) JOIN embeddings ON vec_id = doc_id),
th AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scs QUALIFY rank <= 20),
sims AS (
  SELECT a.query_id, a.vec_id AS x, b.vec_id AS y, CASE WHEN len(a.ws) = 0 OR len(b.ws) = 0 THEN 0 ELSE
    len(list_intersect(a.ws, b.ws))::DOUBLE / len(list_distinct(a.ws || b.ws)) END AS sim
  FROM th a JOIN th b ON a.query_id = b.query_id),
few AS (SELECT query_id FROM th GROUP BY query_id HAVING count(*) <= 5),
{sql_mmr(5)},
picks AS (
  SELECT query_id, vec_id, position FROM ({SQL_PICKS}) WHERE query_id NOT IN (FROM few)
  UNION ALL SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT FROM th WHERE query_id IN (FROM few)),
cited AS (
  SELECT 'Brand#' || p.query_id AS symbol, position, '[' || source || ']'
    || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' Note ' || doc_id END
    || ' (' || strftime(DATE '2024-01-01' + doc_id::INT, '%Y-%m-%d') || ')'
    || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' — https://example.com/' || doc_id END AS citation
  FROM picks p JOIN th USING (query_id, vec_id)),
listed AS (
  SELECT symbol, string_agg('[' || position || '] ' || citation, chr(10) ORDER BY position) FILTER (WHERE position <= 3) AS lines,
    count(*) AS n_sources FROM cited GROUP BY symbol)"""


@query("analysis_sources", with_sql(SQL_SOURCES) + "SELECT symbol, position, citation FROM cited")
def analysis_sources(spark, d):
    """The citations of each symbol, in their order."""
    found = symbol_sources(spark, d)
    return found.select("symbol", F.posexplode("citations").alias("position", "citation")).withColumn("position", F.col("position") + 1)


@query(
    "recommend",
    with_sql(SQL_DAILY, SQL_REGIME, SQL_STATE, SQL_RUNS, SQL_RESOLVED, SQL_ADVICE, SQL_SOURCES)
    + f"""SELECT symbol, recommendation, 'SIGNAL: ' || recommendation || chr(10) || 'CONFIDENCE: MEDIUM'
  || chr(10) || chr(10) || symbol || ' analysis using ' || upper(strategy) || ' strategy:' || chr(10)
  || chr(10) || 'Quantitative Evidence:' || chr(10)
  || printf('- Total Return: %.1f%% over backtest period', {exact('total_return * 100', 1)}) || chr(10)
  || printf('- Sharpe Ratio: %.2f (risk-adjusted performance)', {exact('sharpe_ratio', 2)}) || chr(10)
  || printf('- Maximum Drawdown: %.1f%%', {exact('max_drawdown * 100', 1)}) || chr(10)
  || '- Risk Level: ' || risk_level || chr(10) || chr(10) || 'The ' || strategy || ' strategy '
  || CASE WHEN recommendation = 'BUY' THEN 'shows positive momentum' ELSE 'indicates caution' END
  || ' for ' || symbol || '.' || chr(10) || CASE recommendation
    WHEN 'BUY' THEN 'Strong risk-adjusted returns support a BUY recommendation.'
    WHEN 'HOLD' THEN 'Risk metrics suggest caution — consider HOLD or reduced position.'
    ELSE 'Negative performance metrics suggest avoiding this position.' END
  || chr(10) || chr(10) || 'SOURCES:' || chr(10) || coalesce(lines, 'No sources available.') AS explanation
FROM adv LEFT JOIN listed USING (symbol)""",
)
def recommend(spark, d):
    return full_analysis(spark, d).select("symbol", "recommendation", "explanation")


@query(
    "analyze",
    with_sql(SQL_DAILY, SQL_REGIME, SQL_STATE, SQL_RUNS, SQL_RESOLVED, SQL_ADVICE, SQL_SOURCES)
    + """SELECT symbol, strategy, attempt::INT AS retries, total_return, annualized_return,
  annualized_volatility, sharpe_ratio, sortino_ratio, max_drawdown, calmar_ratio, var_95, cvar_95, win_rate,
  profit_factor, n_trades, n_days, risk_score, risk_level, true AS risk_approved,
  reasons AS rejection_reason, round(sentiment_score, 6)::DOUBLE AS sentiment_score, sentiment_label,
  change_pct, recommendation, coalesce(n_sources, 0)::INT AS n_sources FROM adv LEFT JOIN listed USING (symbol)""",
)
def analyze(spark, d):
    out = full_analysis(spark, d)
    gone = [
        "explanation", "volatility", "run", "z_threshold", "slope", "n_bars", "confidence",
        "sentences", "bullish_words", "bearish_words", "citations", "context",
    ]
    out = out.withColumn("n_sources", F.size("citations"))
    return out.drop(*gone).withColumn("sentiment_score", F.round("sentiment_score", 6))


@query(
    "analysis_row",
    with_sql(SQL_DAILY, SQL_REGIME, SQL_STATE, sql_momentum("daily", 20, 50), sql_backtest("sigs"),
             sql_report("sim"))
    + f""",
rr AS (SELECT symbol, {SQL_REPORT_FIELDS} FROM rep)
SELECT s.symbol, n_bars, change_pct, round(sentiment_score, 6)::DOUBLE AS sentiment_score,
  bullish_words::INT AS bullish_words, sharpe_ratio, max_drawdown, n_trades
FROM state s JOIN rr ON rr.symbol = s.symbol""",
)
def analysis_row(spark, d):
    from barloom.catalog.views import daily_indexed
    from barloom.plans import backtest

    rows = decision.state(decision.regime_features(daily(spark, d)), symbol_evidence(spark, d))
    reports = backtest.run(daily_indexed(spark, d))
    return rows.join(reports, "symbol").select(
        "symbol", "n_bars", "change_pct",
        F.round("sentiment_score", 6).alias("sentiment_score"),
        F.col("bullish_words").cast("int").alias("bullish_words"),
        "sharpe_ratio", "max_drawdown", "n_trades",
    )


@query(
    "compare_rank",
    with_sql(SQL_DAILY, SQL_REGIME, SQL_STATE, SQL_RUNS, SQL_RESOLVED, SQL_ADVICE)
    + """,
asked AS (
  SELECT symbol, substring(symbol, 7)::INT AS position, CASE WHEN substring(symbol, 7)::INT = 0 THEN 0
    ELSE (substring(symbol, 7)::INT - 1) // 5 END AS request
  FROM (SELECT DISTINCT p_brand AS symbol FROM part UNION ALL SELECT 'Brand#0')),
cp AS (
  SELECT symbol, position, request, coalesce(recommendation, 'HOLD') AS signal,
    coalesce(strategy, 'unknown') AS strategy,
    CASE WHEN recommendation IS NULL THEN 'Analysis failed: no data' ELSE 'CONFIDENCE: MEDIUM' END AS summary,
    coalesce(round(0.40 * CASE WHEN sharpe_ratio > 0 THEN least(sharpe_ratio / 3, 1) ELSE 0 END
      + 0.30 * CASE WHEN total_return > 0 THEN least(total_return / 2, 1) ELSE 0 END
      + 0.20 * (1 - least(max_drawdown, 1)) + 0.10 * win_rate, 4), 0)::DOUBLE AS composite_score
  FROM asked LEFT JOIN adv USING (symbol))
SELECT request::BIGINT AS request, symbol, signal, strategy, summary, composite_score,
  row_number() OVER w::INT AS rank,
  first_value(symbol) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best_ticker,
  last_value(symbol) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS worst_ticker
FROM cp WINDOW w AS (PARTITION BY request ORDER BY composite_score DESC, position)""",
)
def compare_rank(spark, d):
    """Brands compared in requests of five; the first request also asks for an unknown one."""
    brands = table(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct()
    unknown = spark.range(1).select(F.lit("Brand#0").alias("symbol"))
    number = F.substring("symbol", 7, 10).cast("int")
    asked = brands.union(unknown).select(
        "symbol", number.alias("position"), F.greatest(F.floor((number - 1) / 5), F.lit(0)).cast("long").alias("request")
    )
    return decision.compare_analyses(asked, full_analysis(spark, d), "request", "position").select(
        "request", "symbol", "signal", "strategy", "summary", "composite_score", "rank", "best_ticker", "worst_ticker"
    )
