"""Portfolio, alerts, calendar, search and request checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.registry import query
from barloom.catalog.views import SQL_DAILY0, SQL_LOTS, daily, index_price, lots, with_sql
from barloom.operators import alerts, calendar, matching, portfolio, quotes, validation
from barloom.session import materialize
from barloom.sources.bars import table


def latest_quotes(spark, d):
    """Latest quotes by ticker."""
    q = quotes.daily_quotes(daily(spark, d)).withColumnRenamed("symbol", "ticker")
    return q.select("ticker", "price", "change_pct", "week_52_high", "week_52_low")


SQL_QUOTES = (
    SQL_DAILY0
    + """,
qlast AS (SELECT symbol, max(ts) AS top FROM daily0 GROUP BY symbol),
qr AS (SELECT d.*, row_number() OVER (PARTITION BY d.symbol ORDER BY d.ts DESC) AS rn
      FROM daily0 d JOIN qlast USING (symbol) WHERE d.ts > top - INTERVAL 365 DAY),
quotes AS (
  SELECT symbol AS ticker, max(close) FILTER (WHERE rn = 1) AS price,
    round((max(close) FILTER (WHERE rn = 1) - max(close) FILTER (WHERE rn = 2))
          / max(close) FILTER (WHERE rn = 2) * 100, 6) AS change_pct,
    max(high) AS week_52_high, min(low) AS week_52_low
  FROM qr GROUP BY symbol)"""
)


def exact(x: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal form, as Spark rounds doubles."""
    return f"round(({x})::VARCHAR::DECIMAL(38, 12), {digits})::DOUBLE"


def sql_positions(keys: str, out: str, digits: int = 4) -> str:
    return f"""
{out} AS (
  SELECT {keys}, sum(shares) AS shares, {exact('sum(shares * entry_price) / sum(shares)', digits)} AS entry_price,
    arg_min(entry_date, seq) AS entry_date,
    coalesce(arg_max(notes, seq) FILTER (WHERE notes <> ''), '') AS notes
  FROM lots GROUP BY {keys})"""


@query(
    "lot_merge",
    with_sql(SQL_LOTS, sql_positions("ticker", "pos"))
    + "SELECT ticker, shares, entry_price, entry_date, notes FROM pos",
)
def lot_merge(spark, d):
    return portfolio.merge_lots(lots(spark, d), ["ticker"])


SQL_PERF = f"""
perf AS (
  SELECT p.*, {exact("coalesce(price, entry_price)", 2)} AS current_price,
    {exact("coalesce(change_pct, 0)", 2)} AS price_change_pct,
    {exact("shares * entry_price", 2)} AS cost_basis,
    {exact("shares * coalesce(price, entry_price)", 2)} AS current_value,
    {exact("shares * coalesce(price, entry_price) - shares * entry_price", 2)} AS unrealized_pnl,
    {exact("(shares * coalesce(price, entry_price) - shares * entry_price) / (shares * entry_price) * 100", 2)}
      AS unrealized_pnl_pct,
    {exact("coalesce(week_52_high, coalesce(price, entry_price))", 2)} AS week_52_high,
    {exact("coalesce(week_52_low, coalesce(price, entry_price))", 2)} AS week_52_low
  FROM pos p LEFT JOIN quotes USING (ticker))"""


@query(
    "portfolio_pnl",
    with_sql(SQL_LOTS, sql_positions("ticker", "pos"), SQL_QUOTES, SQL_PERF) + "SELECT * FROM perf",
)
def portfolio_pnl(spark, d):
    return portfolio.performance(lot_merge(spark, d), latest_quotes(spark, d))


@query(
    "portfolio_totals",
    with_sql(SQL_LOTS, sql_positions("account, ticker", "pos", 10), SQL_QUOTES, SQL_PERF)
    + """
SELECT account, round(sum(cost_basis), 2) AS total_cost_basis,
  round(sum(current_value), 2) AS total_current_value,
  round(sum(current_value) - sum(cost_basis), 2) AS total_unrealized_pnl,
  round((sum(current_value) - sum(cost_basis)) / sum(cost_basis) * 100, 2) AS total_unrealized_pnl_pct,
  arg_min(ticker, (-unrealized_pnl_pct, ticker)) AS best_performer,
  arg_min(ticker, (unrealized_pnl_pct, ticker)) AS worst_performer, count(*) AS position_count
FROM perf GROUP BY account""",
)
def portfolio_totals(spark, d):
    held = portfolio.merge_lots(lots(spark, d), ["account", "ticker"], 10)
    return portfolio.totals(portfolio.performance(held, latest_quotes(spark, d)), ["account"])


@query(
    "account_rollup",
    with_sql(SQL_LOTS, sql_positions("account, ticker", "pos", 10), SQL_QUOTES, SQL_PERF)
    + """,
held AS (SELECT account, sum(unrealized_pnl) AS pnl, sum(current_value) AS v, count(*) AS n
         FROM perf GROUP BY account)
SELECT c_custkey AS account, c_acctbal AS cash, round(c_acctbal + coalesce(v, 0), 2) AS portfolio_value,
  round(c_acctbal + coalesce(v, 0) - 100000, 2) AS total_pnl,
  round((c_acctbal + coalesce(v, 0) - 100000) / 100000, 8) AS total_pnl_pct,
  round(coalesce(pnl, 0), 2) AS unrealized_pnl, coalesce(n, 0) AS position_count
FROM customer LEFT JOIN held ON account = c_custkey""",
)
def account_rollup(spark, d):
    held = portfolio.merge_lots(lots(spark, d), ["account", "ticker"], 10)
    cash = table(spark, d, "customer").select(
        F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("cash")
    )
    out = portfolio.account_rollup(portfolio.performance(held, latest_quotes(spark, d)), cash)
    return out.withColumns(
        {
            "portfolio_value": F.round("portfolio_value", 2),
            "total_pnl": F.round("total_pnl", 2),
            "total_pnl_pct": F.round("total_pnl_pct", 8),
            "unrealized_pnl": F.round("unrealized_pnl", 2),
        }
    )


@query(
    "positions_after_removal",
    with_sql(SQL_LOTS, sql_positions("account, ticker", "pos", 10))
    + """
SELECT account, count(*) AS positions, round(sum(shares * entry_price), 6) AS total_cost
FROM pos WHERE (account, ticker) NOT IN (SELECT (account, ticker) FROM lots WHERE notes = '5-LOW')
GROUP BY account""",
)
def positions_after_removal(spark, d):
    rows = lots(spark, d)
    gone = rows.filter(F.col("notes") == "5-LOW").select("account", "ticker")
    held = portfolio.merge_lots(rows, ["account", "ticker"], 10)
    return portfolio.cost_by(portfolio.without(held, gone, ["account", "ticker"]), "account", 6)


@query(
    "recent_orders",
    """SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""",
)
def recent_orders(spark, d):
    return (
        table(spark, d, "orders")
        .select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        .orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
        .limit(50)
    )


# --- alerts ----------------------------------------------------------------------------


def alert_actions(spark, d):
    """Order lines read as a log of alert commands per brand."""
    tax, disc = F.col("l_tax"), F.col("l_discount")
    action = (
        F.when((tax == 0) & (disc == 0), "remove_all").when(tax == 0, "remove").otherwise("add")
    )
    kind = (
        F.when(F.col("l_returnflag") == "A", "price_below")
        .when(F.col("l_returnflag") == "R", "price_above")
        .when(F.col("l_linestatus") == "F", "change_pct_below")
        .otherwise("change_pct_above")
    )
    level = F.when(kind.startswith("price"), index_price()).otherwise(F.col("l_quantity") - 25)
    return (
        table(spark, d, "lineitem")
        .join(
            table(spark, d, "part").select("p_partkey", "p_brand"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
        .select(
            F.col("p_brand").alias("symbol"),
            kind.alias("condition"),
            action.alias("action"),
            level.alias("threshold"),
            F.when(disc > 0.05, F.lit("watch")).otherwise("").alias("note"),
            F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias(
                "seq"
            ),
        )
    )


SQL_REGISTRY = """
acts AS (
  SELECT p_brand AS symbol, CASE WHEN l_returnflag = 'A' THEN 'price_below'
      WHEN l_returnflag = 'R' THEN 'price_above' WHEN l_linestatus = 'F' THEN 'change_pct_below'
      ELSE 'change_pct_above' END AS condition,
    CASE WHEN l_tax = 0 AND l_discount = 0 THEN 'remove_all' WHEN l_tax = 0 THEN 'remove'
      ELSE 'add' END AS action,
    CASE WHEN l_returnflag IN ('A', 'R') THEN 100 + l_extendedprice / l_quantity / 1000
      ELSE l_quantity - 25 END AS threshold,
    CASE WHEN l_discount > 0.05 THEN 'watch' ELSE '' END AS note,
    row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey),
wiped AS (SELECT symbol, max(seq) AS w FROM acts WHERE action = 'remove_all' GROUP BY symbol),
reg AS (
  SELECT symbol, condition, arg_max(threshold, seq) FILTER (WHERE action = 'add') AS threshold,
    arg_max(note, seq) FILTER (WHERE action = 'add') AS note
  FROM acts LEFT JOIN wiped USING (symbol)
  WHERE action <> 'remove_all'
  GROUP BY symbol, condition
  HAVING max(seq) FILTER (WHERE action = 'add')
    > greatest(coalesce(max(seq) FILTER (WHERE action = 'remove'), 0), coalesce(max(w), 0)))"""


@query(
    "alert_registry",
    with_sql(SQL_REGISTRY) + "SELECT symbol, condition, threshold, note FROM reg",
)
def alert_registry(spark, d):
    return alerts.registry(alert_actions(spark, d))


@query(
    "alert_eval",
    with_sql(SQL_REGISTRY, SQL_DAILY0)
    + f""",
dayq AS (SELECT symbol, ts, close AS price, round((close - open) / open * 100, 6) AS change_pct FROM daily0),
ev AS (
  SELECT *, CASE condition WHEN 'price_below' THEN price < threshold WHEN 'price_above'
    THEN price > threshold WHEN 'change_pct_below' THEN change_pct < threshold
    ELSE change_pct > threshold END AS triggered
  FROM reg JOIN dayq USING (symbol))
SELECT symbol, ts, condition, threshold, note, price, change_pct, triggered,
  CASE WHEN triggered THEN '🚨 ' || symbol || ' ' || CASE condition
    WHEN 'price_below' THEN printf('dropped below $%.2f', {exact('threshold', 2)})
    WHEN 'price_above' THEN printf('rose above $%.2f', {exact('threshold', 2)})
    WHEN 'change_pct_below' THEN printf('fell %.1f%% today', threshold)
    ELSE printf('gained %.1f%% today', threshold) END
    || printf(' (current: $%.2f, %+.2f%% today)', {exact("price", 2)}, change_pct)
    || CASE WHEN note <> '' THEN ' — ' || note ELSE '' END END AS message
FROM ev""",
)
def alert_eval(spark, d):
    """Alerts in force against every trading day of their symbol."""
    change = F.round((F.col("close") - F.col("open")) / F.col("open") * 100, 6)
    days = daily(spark, d).select(
        "symbol", "ts", F.col("close").alias("price"), change.alias("change_pct")
    )
    return alerts.evaluate(alert_registry(spark, d), days)


def command_log(spark, d):
    """Events as clients' JSON commands; their properties set threshold and kind, every 97th is cut short."""
    k = F.get_json_object("props", "$.k").cast("int")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    action = F.when(k < 60, "add").when(k < 85, "remove").when(k < 90, "list").when(k < 95, "ping").otherwise("unknown")
    condition = F.element_at(F.array(*map(F.lit, alerts.CONDITIONS)), (k % 4 + 1).cast("int"))
    fields = [
        F.concat(F.lit('"action": '), text(action)),
        F.when(F.col("event_id") % 53 != 0, F.concat(F.lit('"ticker": '), text(F.lower("event_type")))),
        F.when(k % 5 != 0, F.concat(F.lit('"condition": '), text(condition))),
        F.when(k % 3 != 0, F.concat(F.lit('"threshold": '), F.col("value").cast("string"))),
    ]
    whole = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ", "), F.lit("}"))
    data = F.when(F.col("event_id") % 97 == 0, F.expr("substring(w, 1, length(w) - 3)")).otherwise(F.col("w"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_id", whole.alias("w"))
    return rows.select("seq", data.alias("data"))


SQL_COMMANDS = """
cmd0 AS (SELECT *, event_id AS seq, json_extract(props, '$.k')::INT AS k FROM events),
cmd AS (
  SELECT seq, CASE WHEN seq % 97 = 0 THEN 'Invalid JSON' WHEN k < 60 AND seq % 53 = 0
      THEN 'Missing field: ' || chr(39) || 'ticker' || chr(39) END AS error,
    CASE WHEN k < 60 THEN 'add' WHEN k < 85 THEN 'remove' WHEN k < 90 THEN 'list' WHEN k < 95 THEN 'ping' END AS act,
    CASE WHEN seq % 53 = 0 THEN '' ELSE upper(event_type) END AS symbol,
    CASE WHEN k % 5 <> 0 THEN ['price_below', 'price_above', 'change_pct_below', 'change_pct_above'][k % 4 + 1]
      WHEN k < 60 THEN 'price_below' END AS condition,
    CASE WHEN k % 3 <> 0 THEN value ELSE 0 END AS threshold
  FROM cmd0 WHERE k < 95 OR seq % 97 = 0)"""


@query(
    "alert_commands",
    with_sql(SQL_COMMANDS)
    + """,
ok AS (SELECT * FROM cmd WHERE error IS NULL),
steps AS (
  SELECT seq, symbol, condition, act FROM ok WHERE act = 'add' OR (act = 'remove' AND condition IS NOT NULL)
  UNION ALL
  SELECT seq, symbol, h.condition, act FROM ok JOIN (SELECT DISTINCT symbol, condition FROM ok WHERE act = 'add') h USING (symbol)
  WHERE act = 'remove' AND ok.condition IS NULL),
was AS (SELECT *, lag(act) OVER (PARTITION BY symbol, condition ORDER BY seq) AS before FROM steps),
gone AS (SELECT seq, count(*) FILTER (before = 'add') AS n FROM was WHERE act = 'remove' GROUP BY seq)
SELECT seq, CASE WHEN error IS NOT NULL THEN 'error' WHEN act = 'add' THEN 'alert_added' WHEN act = 'remove' THEN 'alert_removed'
    WHEN act = 'list' THEN 'alert_list' ELSE 'pong' END AS type,
  CASE WHEN error IS NULL AND act IN ('add', 'remove') THEN symbol ELSE '-' END AS symbol,
  CASE WHEN error IS NULL AND act = 'remove' THEN coalesce(n, 0) ELSE -1 END AS count,
  CASE WHEN error IS NOT NULL THEN error WHEN act = 'add' THEN 'Alert set: ' || symbol || ' ' || condition ELSE '-' END AS message,
  CASE WHEN error IS NULL AND act = 'add' THEN threshold ELSE -1 END AS threshold
FROM cmd LEFT JOIN gone USING (seq)""",
)
def alert_commands(spark, d):
    """The answers to all commands, and the thresholds that were read."""
    told = materialize(alerts.commands(command_log(spark, d)), "commands")
    read = told.where("action = 'add'").select("seq", "threshold")
    out = alerts.replies(told).join(read, "seq", "left")
    said = F.when(F.col("type") == "alert_added", F.substring_index("message", " ", 4)).otherwise(F.coalesce("message", F.lit("-")))
    return out.select(
        "seq", "type", F.coalesce("symbol", F.lit("-")).alias("symbol"), F.coalesce("count", F.lit(-1)).alias("count"),
        said.alias("message"), F.coalesce("threshold", F.lit(-1.0)).alias("threshold"),
    )


# --- calendar --------------------------------------------------------------------------


def segment_orders(spark, d, status: str):
    orders = table(spark, d, "orders").filter(F.col("o_orderstatus") == status)
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("ticker"), F.col("o_orderdate").alias("date"), "o_orderkey"
    )


@query(
    "next_event",
    """
WITH e AS (SELECT DISTINCT c_mktsegment AS ticker, o_orderdate AS date FROM orders
           JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'),
a AS (SELECT c_mktsegment AS ticker, o_orderdate AS date, o_orderkey FROM orders
      JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'),
n AS (SELECT ticker, date, (SELECT min(e.date) FROM e WHERE e.ticker = a.ticker AND e.date > a.date)
        AS next_date FROM (SELECT DISTINCT ticker, date FROM a) a)
SELECT ticker, date, o_orderkey, next_date FROM a JOIN n USING (ticker, date)""",
)
def next_event(spark, d):
    return calendar.next_events(segment_orders(spark, d, "F"), segment_orders(spark, d, "O"))


@query(
    "earnings_calendar",
    """
WITH f AS (
  SELECT o_custkey, min(o_orderdate) FILTER (WHERE o_orderdate > TIMESTAMP '2001-06-01 12:00:00') AS a,
         max(o_orderdate) FILTER (WHERE o_orderdate <= TIMESTAMP '2001-06-01 12:00:00') AS b
  FROM orders GROUP BY o_custkey),
c AS (
  SELECT c_name AS ticker, coalesce(a, b) AS seen,
    floor((epoch(coalesce(a, b)) - epoch(TIMESTAMP '2001-06-01 12:00:00')) / 86400)::INT AS days
  FROM customer LEFT JOIN f ON o_custkey = c_custkey)
SELECT ticker, strftime(seen, '%Y-%m-%d') AS next_earnings_date, days AS days_until_earnings,
  CASE WHEN days IS NULL THEN 'unknown' WHEN days < 0 THEN 'past' WHEN days = 0 THEN 'today'
    WHEN days <= 3 THEN 'critical' WHEN days <= 7 THEN 'warning' ELSE 'info' END AS warning_level,
  CASE WHEN days IS NULL THEN 'Earnings date not available for this ticker'
    WHEN days < 0 THEN 'Last earnings: ' || strftime(seen, '%Y-%m-%d') || ' (' || abs(days) || ' days ago)'
    WHEN days = 0 THEN '🚨 EARNINGS TODAY — Do not trade based on pre-earnings analysis!'
    WHEN days <= 3 THEN '⚠️ Earnings in ' || days || ' day(s) (' || strftime(seen, '%b %d')
      || ') — HIGH RISK period'
    WHEN days <= 7 THEN '📅 Earnings in ' || days || ' days (' || strftime(seen, '%b %d')
      || ') — analysis may change after earnings'
    ELSE 'Next earnings: ' || strftime(seen, '%B %d, %Y') || ' (' || days || ' days away)' END AS message,
  coalesce(days BETWEEN 0 AND 30, false) AS has_upcoming_earnings
FROM c""",
)
def earnings_calendar(spark, d):
    tickers = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("ticker"))
    dated = (
        table(spark, d, "orders")
        .join(tickers, F.col("o_custkey") == F.col("c_custkey"))
        .select("ticker", F.col("o_orderdate").alias("date"))
    )
    found = calendar.earnings_calendar(tickers.select("ticker"), dated, "2001-06-01 12:00:00")
    return found.orderBy(F.col("days_until_earnings").asc_nulls_last(), "ticker")


# --- search and checks -----------------------------------------------------------------


def instruments(spark, d):
    kind = (
        F.when(F.col("p_type") == "PROMO", "OPTION")
        .when(F.col("p_type") == "ECONOMY", "ETF")
        .when(F.col("p_type") == "STANDARD", "MUTUALFUND")
        .otherwise("EQUITY")
    )
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("pos"),
        F.concat_ws("-", "p_brand", "p_partkey").alias("symbol"),
        F.col("p_name").alias("name"),
        kind.alias("type"),
    )


@query(
    "instrument_search",
    """
WITH i AS (
  SELECT p_partkey AS pos, p_brand || '-' || p_partkey AS symbol, p_name AS name,
    CASE p_type WHEN 'PROMO' THEN 'OPTION' WHEN 'ECONOMY' THEN 'ETF' WHEN 'STANDARD' THEN 'MUTUALFUND'
      ELSE 'EQUITY' END AS type FROM part),
l AS (SELECT *, CASE type WHEN 'ETF' THEN 'ETF' WHEN 'MUTUALFUND' THEN 'Fund' ELSE 'Equity' END
        AS type_display FROM i WHERE type <> 'OPTION'),
q AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS q FROM part
      UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT ' ' || left(p_name, 2) FROM part),
h AS (SELECT q, l.*, row_number() OVER (PARTITION BY q ORDER BY
        CASE WHEN starts_with(lower(symbol), lower(trim(q))) THEN 0 ELSE 1 END, pos)::INT AS rank
      FROM q JOIN l ON contains(lower(symbol || ' ' || name), lower(trim(q))))
SELECT q, pos, symbol, name, type, type_display, rank FROM h WHERE rank <= 8""",
)
def instrument_search(spark, d):
    part = table(spark, d, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("q"))
    asks = words.union(part.select("p_brand")).union(
        part.select(F.concat(F.lit(" "), F.substring("p_name", 1, 2)))
    )
    return matching.search(matching.listed(instruments(spark, d)), asks.distinct())


@query(
    "validate_requests",
    """
WITH r AS (
  SELECT conv_id, turn, ' ' || role || '-' || conv_id AS ticker, text AS query,
    CASE WHEN role = 'system' THEN 'soon' ELSE strftime(DATE '2020-01-01' + conv_id::INT, '%Y-%m-%d') END
      AS start_date, strftime(DATE '2020-01-01' + (turn * 60 + 10)::INT, '%Y-%m-%d') AS end_date
  FROM conversations)
SELECT conv_id, turn, ticker, CASE
  WHEN length(ticker) > 20 THEN 'ticker must have 1-20 characters'
  WHEN length(query) < 5 OR length(query) > 500 THEN 'query must have 5-500 characters'
  WHEN trim(query) = '' THEN 'query must not be empty'
  WHEN try_cast(start_date AS DATE) IS NULL THEN 'dates must be YYYY-MM-DD'
  WHEN start_date >= end_date THEN 'start must be before end' END AS reason,
  length(trim(ticker)) BETWEEN 1 AND 12 AS chart_ok
FROM r""",
)
def validate_requests(spark, d):
    system = F.col("role") == "system"
    first = F.date_add(F.lit("2020-01-01").cast("date"), F.col("conv_id").cast("int"))
    last = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("turn") * 60 + 10).cast("int"))
    asked = table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.concat(F.lit(" "), F.col("role"), F.lit("-"), F.col("conv_id")).alias("ticker"),
        F.col("text").alias("query"),
        F.when(system, "soon").otherwise(F.date_format(first, "yyyy-MM-dd")).alias("start_date"),
        F.date_format(last, "yyyy-MM-dd").alias("end_date"),
    )
    reason = validation.request_reason(
        F.col("ticker"), F.col("query"), F.col("start_date"), F.col("end_date")
    )
    return asked.select(
        "conv_id",
        "turn",
        "ticker",
        reason.alias("reason"),
        validation.chart_ticker_ok(F.col("ticker")).alias("chart_ok"),
    )


@query(
    "history_list",
    """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
           FROM events WHERE value > 0)
SELECT event_id AS id, event_type AS ticker, ts AS created_at, value AS score FROM h WHERE rn <= 10""",
)
def history_list(spark, d):
    from barloom.sources import history

    saved = table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("ticker"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("score"),
        F.col("props").alias("equity_curve"),
    )
    gone = saved.filter(F.col("score") <= 0).select("id")
    return history.recent(history.delete(saved, gone), 10)


def analyses(spark, d):
    """Events as stored analyses."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("ticker"),
        F.col("ts").alias("created_at"), F.col("value").alias("score"),
    )


@query(
    "history_page",
    """SELECT event_id AS id, event_type AS ticker, ts AS created_at, value AS score FROM events
WHERE event_type = (SELECT min(event_type) FROM events) AND value > 0
ORDER BY ts DESC, event_id DESC LIMIT 50""",
)
def history_page(spark, d):
    """The newest page of the first ticker, after analyses were deleted by id."""
    from barloom.sources import history

    saved = analyses(spark, d)
    gone = saved.where("score <= 0").select("id")
    first = saved.agg(F.min("ticker").alias("ticker"))
    own = history.delete(saved, gone).join(first, "ticker", "left_semi")
    return history.newest(own.select("id", "ticker", "created_at", "score"), limit=50)


@query(
    "position_checks",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN trim(l_returnflag) = '' THEN 'ticker must not be empty'
  WHEN NOT l_quantity - 10 > 0 THEN 'shares must be positive'
  WHEN NOT l_extendedprice - 20000 > 0 THEN 'price must be positive' END AS reason FROM lineitem""",
)
def position_checks(spark, d):
    """Lines as new positions, some with too few shares or too low a price."""
    reason = validation.position_reason(
        F.col("l_returnflag"), F.col("l_quantity") - 10, F.col("l_extendedprice") - 20000
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", reason.alias("reason"))


@query(
    "compare_checks",
    """SELECT l_orderkey, CASE WHEN count(DISTINCT l_partkey) NOT BETWEEN 2 AND 10 THEN '2 to 10 tickers are compared' END
  AS reason FROM lineitem GROUP BY l_orderkey""",
)
def compare_checks(spark, d):
    """The parts of an order as tickers to compare."""
    asked = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("tickers"))
    return asked.select("l_orderkey", validation.compare_reason(F.col("tickers")).alias("reason"))


@query(
    "config_checks",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice - 5000 > 0 AND l_discount * 12 > 0
  AND l_discount * 12 <= 1 AND l_tax * 14 >= 0 AND l_tax * 14 < 1 AND l_tax * 1.5 >= 0 AND l_tax * 1.5 < 0.1 AS ok
FROM lineitem""",
)
def config_checks(spark, d):
    """Lines as engine settings: capital, position size, stop loss, commission."""
    ok = validation.valid_config(
        F.col("l_extendedprice") - 5000, F.col("l_discount") * 12, F.col("l_tax") * 14, F.col("l_tax") * 1.5
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ok.alias("ok"))


@query(
    "dim_key_pad",
    """SELECT upper(c_name) AS ticker, lpad(c_custkey::VARCHAR, 10, '0') AS filer_id, n_name AS home
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def dim_key_pad(spark, d):
    from barloom.sources import filings

    customers = table(spark, d, "customer").select(
        F.col("c_name").alias("ticker"), F.col("c_custkey").alias("id"), "c_nationkey"
    )
    nations = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("home"))
    return filings.filer_ids(customers).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("ticker", "filer_id", "home")
