"""Price alerts: registry, evaluation and message text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The alert conditions.
CONDITIONS = ["price_below", "price_above", "change_pct_below", "change_pct_above"]


def fires(condition: Column, threshold: Column, price: Column, change: Column) -> Column:
    """Strict comparison of price or change with the threshold."""
    return (
        F.when(condition == "price_below", price < threshold)
        .when(condition == "price_above", price > threshold)
        .when(condition == "change_pct_below", change < threshold)
        .when(condition == "change_pct_above", change > threshold)
        .otherwise(False)
    )


# The texts of a message.
def message(symbol, condition, threshold, note, price, change) -> Column:
    what = (
        F.when(condition == "price_below", F.format_string("dropped below $%.2f", threshold))
        .when(condition == "price_above", F.format_string("rose above $%.2f", threshold))
        .when(condition == "change_pct_below", F.format_string("fell %.1f%% today", threshold))
        .when(condition == "change_pct_above", F.format_string("gained %.1f%% today", threshold))
        .otherwise(F.format_string("crossed %s", threshold.cast("string")))
    )
    extra = F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit(" — "), note)).otherwise("")
    return F.concat(
        F.format_string("🚨 %s %s (current: $%.2f, %+.2f%% today)", symbol, what, price, change), extra
    )


#: Fields of a command; what is not JSON ends up in ``broken``.
COMMAND = "action string, ticker string, condition string, threshold string, message string, broken string"
ACTIONS = ["add", "remove", "list", "ping"]


def commands(log: DataFrame) -> DataFrame:
    """``log(seq, data)`` of JSON texts as ``(seq, action, symbol, condition, threshold, note, error)``.

    A removal without a condition becomes ``remove_all``. What cannot be read has an error and no action;
    actions that nobody knows are left out, as clients get no answer to them.
    """
    c = F.from_json("data", COMMAND, {"columnNameOfCorruptRecord": "broken"})
    rows = log.select("seq", c.alias("c")).select("seq", "c.*")
    bare = F.col("ticker").isNull()
    rows = rows.withColumn(
        "error",
        F.when(F.col("broken").isNotNull(), "Invalid JSON").when((F.col("action") == "add") & bare, "Missing field: 'ticker'"),
    )
    rows = rows.where(F.col("error").isNotNull() | F.col("action").isin(ACTIONS))
    alone = (F.col("action") == "remove") & F.col("condition").isNull()
    return rows.select(
        "seq",
        F.when(F.col("error").isNull(), F.when(alone, "remove_all").otherwise(F.col("action"))).alias("action"),
        F.upper(F.coalesce("ticker", F.lit(""))).alias("symbol"),
        F.when(F.col("action") == "add", F.coalesce("condition", F.lit("price_below"))).otherwise(F.col("condition")).alias("condition"),
        F.coalesce(F.col("threshold").try_cast("double"), F.lit(0.0)).alias("threshold"),
        F.coalesce("message", F.lit("")).alias("note"),
        "error",
    )


def replies(told: DataFrame) -> DataFrame:
    """``(seq, type, symbol, count, message)``: the answer to each command.

    A removal is told how many alerts were in force just before it. Removals of a whole symbol meet
    the conditions that it has ever had, by an equi-join.
    """
    changes = told.where(F.col("action").isin("add", "remove", "remove_all"))
    held = changes.where(F.col("action") == "add").select("symbol", F.col("condition").alias("_c")).distinct()
    each = changes.where(F.col("action") != "remove_all").select("seq", "symbol", "condition", "action")
    wide = changes.where(F.col("action") == "remove_all").join(held, "symbol").select("seq", "symbol", F.col("_c").alias("condition"), "action")
    line = Window.partitionBy("symbol", "condition").orderBy("seq")
    steps = each.union(wide).withColumn("_was", F.lag("action").over(line))
    gone = steps.where(F.col("action") != "add").groupBy("seq").agg(F.count_if(F.col("_was") == "add").alias("_gone"))
    kind = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("action") == "add", "alert_added")
        .when(F.col("action").startswith("remove"), "alert_removed")
        .when(F.col("action") == "list", "alert_list")
        .otherwise("pong")
    )
    said = F.when(F.col("error").isNotNull(), F.col("error")).when(
        F.col("action") == "add", F.concat(F.lit("Alert set: "), F.concat_ws(" ", "symbol", "condition", F.col("threshold").cast("string")))
    )
    return told.join(gone, "seq", "left").select(
        "seq",
        kind.alias("type"),
        F.when(F.col("action").isin("add", "remove", "remove_all"), F.col("symbol")).alias("symbol"),
        F.when(F.col("action").startswith("remove"), F.coalesce("_gone", F.lit(0))).alias("count"),
        said.alias("message"),
    )


def registry(actions: DataFrame) -> DataFrame:
    """Alerts in force after a log of actions.

    ``actions(symbol, condition, action, threshold, note, seq)`` where ``action`` is
    ``add``, ``remove`` (one condition) or ``remove_all`` (the whole symbol). One alert per
    symbol and condition; the last one added wins. Every step is a map-side aggregation.
    """
    adds = F.when(F.col("action") == "add", F.col("seq"))
    drops = F.when(F.col("action") == "remove", F.col("seq"))
    wipes = F.when(F.col("action") == "remove_all", F.col("seq"))
    by_key = actions.filter(F.col("action") != "remove_all").groupBy("symbol", "condition").agg(
        F.max_by(F.struct("threshold", "note"), adds).alias("_alert"),
        F.max(adds).alias("_added"),
        F.max(drops).alias("_dropped"),
    )
    by_symbol = actions.groupBy("symbol").agg(F.max(wipes).alias("_wiped"))
    kept = (
        F.col("_added").isNotNull()
        & (F.col("_dropped").isNull() | (F.col("_added") > F.col("_dropped")))
        & (F.col("_wiped").isNull() | (F.col("_added") > F.col("_wiped")))
    )
    return (
        by_key.join(by_symbol, "symbol")
        .filter(kept)
        .select("symbol", "condition", F.col("_alert.threshold"), F.col("_alert.note"))
    )


def evaluate(alerts: DataFrame, quotes: DataFrame) -> DataFrame:
    """Alerts beside the quote of their symbol, with ``triggered`` and the message.

    Symbols without a quote are skipped. ``quotes(symbol, price, change_pct)``.
    """
    args = [F.col(c) for c in ("condition", "threshold", "price", "change_pct")]
    text = message(*[F.col(c) for c in ("symbol", "condition", "threshold", "note", "price", "change_pct")])
    return alerts.join(quotes, "symbol").withColumns(
        {"triggered": fires(*args), "message": F.when(fires(*args), text)}
    )
