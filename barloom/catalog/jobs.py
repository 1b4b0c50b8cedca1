"""Grid search, walk-forward, range queries and what-if scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from barloom.catalog.registry import ORACLES, query
from barloom.catalog.trend import sql_rsi, sql_walk
from barloom.catalog.views import (
    SQL_DAILY, daily, daily_indexed, index_price, sql_backtest, sql_momentum, sql_report, with_sql,
)
from barloom.operators import ranges
from barloom.operators.signals import DEFAULTS
from barloom.operators.validation import bars_needed
from barloom.operators.validation import valid_params as params_ok
from barloom.plans import search, walkforward, whatif
from barloom.session import materialize
from barloom.sources.bars import table


def sql_runs(combos: list[dict]) -> str:
    rows = ", ".join(
        f"({i}, '{search.params_text(p)}', {p['short_window']}, {p['long_window']})"
        for i, p in enumerate(combos)
    )
    return f"runs(run, params, a, b) AS (VALUES {rows})"


def sql_crossover_runs(source: str, keys: str, combos: list[dict], out: str) -> str:
    """``source`` rows times runs, each with its crossover signal."""
    sizes = sorted({p[k] for p in combos for k in ("short_window", "long_window")})
    w = f"(PARTITION BY {keys} ORDER BY idx"
    mas = ",\n    ".join(
        f"CASE WHEN idx >= {s - 1} THEN avg(close) OVER {w} ROWS {s - 1} PRECEDING) END AS m{s}"
        for s in sizes
    )
    pick = lambda c: "CASE " + " ".join(f"WHEN {c} = {s} THEN m{s}" for s in sizes) + " END"
    wr = f"(PARTITION BY {keys}, run ORDER BY idx)"
    return f"""
{out}_m AS (
  SELECT *, count(*) OVER (PARTITION BY {keys}) AS n_bars,
    {mas}
  FROM {source}),
{out}_x AS (SELECT *, {pick('a')} AS fast, {pick('b')} AS slow FROM {out}_m CROSS JOIN runs),
{out} AS (
  SELECT *, CASE
    WHEN idx >= b AND lag(fast) OVER {wr} <= lag(slow) OVER {wr} AND fast > slow THEN 1
    WHEN idx >= b AND lag(fast) OVER {wr} >= lag(slow) OVER {wr} AND fast < slow THEN -1
    ELSE 0 END AS signal FROM {out}_x)"""


GRID = search.combinations("momentum")


@query(
    "grid_search",
    with_sql(
        SQL_DAILY,
        sql_runs(GRID),
        sql_crossover_runs("daily", "symbol", GRID, "gs"),
        sql_backtest("gs", "symbol, run", "gsim"),
        sql_report("gsim", "symbol, run", "grep_"),
    )
    + f""",
sc AS (
  SELECT g.*, params, round(sharpe_ratio, 4) AS score FROM grep_ g JOIN runs USING (run)
  JOIN (SELECT symbol, count(*) AS n FROM daily GROUP BY symbol) USING (symbol) WHERE n > b),
df AS (SELECT symbol, max(score) AS best,
              coalesce(max(score) FILTER (WHERE params = 'short_window=20,long_window=50'), 0) AS base
       FROM sc GROUP BY symbol)
SELECT symbol, params, round(sharpe_ratio, 3)::DOUBLE AS sharpe_ratio,
  round(total_return, 4)::DOUBLE AS total_return, round(max_drawdown, 4)::DOUBLE AS max_drawdown,
  round(calmar_ratio, 3)::DOUBLE AS calmar_ratio, round(win_rate, 3)::DOUBLE AS win_rate, n_trades,
  score::DOUBLE AS score,
  row_number() OVER (PARTITION BY symbol ORDER BY score DESC NULLS LAST, run)::INT AS rank,
  base::DOUBLE AS default_score,
  round(CASE WHEN base <> 0 THEN (best - base) / abs(base) * 100 ELSE 0 END, 1)::DOUBLE
    AS improvement_pct
FROM sc JOIN df USING (symbol)""",
)
def grid_search(spark, d):
    return search.grid_search(daily_indexed(spark, d))


def sql_params(strategy: str, combos: list[dict]) -> str:
    rows = ", ".join(
        f"({i}, '{search.params_text(p)}', {bars_needed(strategy, p)})" for i, p in enumerate(combos)
    )
    return f"runs(run, params, need) AS (VALUES {rows})"


def sql_rsi_runs(combos: list[dict]) -> str:
    """Signals ``gs`` of every RSI run: one walk per period."""
    walks, parts = [], []
    for n in sorted({p["period"] for p in combos}):
        rules = ", ".join(
            f"({i}, {p['oversold']}, {p['overbought']})"
            for i, p in enumerate(combos)
            if p["period"] == n
        )
        walks += [
            sql_rsi(n, f"rsi{n}").strip(),
            f"""prev{n} AS (SELECT symbol, idx, lag(rsi) OVER (PARTITION BY symbol ORDER BY idx) AS p
                FROM rsi{n})""",
        ]
        parts.append(
            f"""SELECT d.symbol, run, d.idx, open, close,
  CASE WHEN p < lo THEN 1 WHEN p > hi THEN -1 ELSE 0 END AS signal
FROM daily d JOIN prev{n} USING (symbol, idx) CROSS JOIN (VALUES {rules}) r(run, lo, hi)"""
        )
    return ",".join(walks) + ",gs AS (" + " UNION ALL ".join(parts) + ")"


def sql_macd_runs(combos: list[dict]) -> str:
    """Signals ``gs`` of every MACD run: one walk holding all averages and signal lines."""
    spans = sorted({p[k] for p in combos for k in ("fast", "slow")})
    step = {s: f"(2.0::DOUBLE / {s + 1} * cs[i + 1] + {s - 1}.0::DOUBLE / {s + 1} * e{s})" for s in spans}
    first = "1::BIGINT AS i, " + ", ".join(f"cs[1] AS e{s}" for s in spans)
    first += ", " + ", ".join(f"0.0::DOUBLE AS g{i}" for i in range(len(combos)))
    lines = [
        f"2.0::DOUBLE / {p['signal_period'] + 1} * ({step[p['fast']]} - {step[p['slow']]}) "
        f"+ {p['signal_period'] - 1}.0::DOUBLE / {p['signal_period'] + 1} * g{i}"
        for i, p in enumerate(combos)
    ]
    walk = sql_walk("mw", first, "i + 1, " + ", ".join([*step.values(), *lines])).strip()
    hists = " UNION ALL ".join(
        f"SELECT symbol, i - 1 AS idx, {i} AS run, {p['slow'] + p['signal_period']} AS live, "
        f"e{p['fast']} - e{p['slow']} - g{i} AS h FROM mw"
        for i, p in enumerate(combos)
    )
    return f"""{walk},
hs AS ({hists}),
hl AS (SELECT *, lag(h, 1) OVER w AS h1, lag(h, 2) OVER w AS h2 FROM hs
       WINDOW w AS (PARTITION BY symbol, run ORDER BY idx)),
gs AS (
  SELECT symbol, run, idx, open, close, CASE WHEN idx >= live AND h2 < 0 AND h1 >= 0 THEN 1
    WHEN idx >= live AND h2 > 0 AND h1 <= 0 THEN -1 ELSE 0 END AS signal
  FROM hl JOIN daily USING (symbol, idx))"""


def sql_reversion_runs(combos: list[dict]) -> str:
    """Signals ``gs`` of every reversion run: one walk whose state is the position per run."""
    sizes = sorted({p["window"] for p in combos})
    w = "(PARTITION BY symbol ORDER BY idx ROWS {} PRECEDING)"
    z = ", ".join(
        f"""CASE WHEN idx >= {n} AND stddev_samp(close) OVER {w.format(n - 1)} > 1e-10
  THEN (close - avg(close) OVER {w.format(n - 1)}) / stddev_samp(close) OVER {w.format(n - 1)} END AS z{n}"""
        for n in sizes
    )
    lists = ", ".join(f"list(z{n} ORDER BY idx) AS l{n}" for n in sizes)
    names = ", ".join(f"l{n}" for n in sizes)

    def move(i: int, p: dict, at: str) -> str:
        v, t = f"l{p['window']}[{at}]", p["z_threshold"]
        return f"""CASE WHEN {v} IS NULL THEN 0 WHEN p{i} = 0 AND {v} < -{t} THEN 1
  WHEN p{i} = 0 AND {v} > {t} THEN -1 WHEN p{i} = 1 AND {v} >= 0 THEN -1
  WHEN p{i} = -1 AND {v} <= 0 THEN 1 ELSE 0 END"""

    steps = ", ".join(f"p{i} + {move(i, p, 'i + 1')}" for i, p in enumerate(combos))
    rows = " UNION ALL ".join(
        f"""SELECT symbol, i - 1 AS idx, {i} AS run, p{i}
  - coalesce(lag(p{i}) OVER (PARTITION BY symbol ORDER BY i), 0) AS signal FROM rw"""
        for i in range(len(combos))
    )
    zeros = ", ".join(f"0 AS p{i}" for i in range(len(combos)))
    return f"""zr AS (SELECT symbol, idx, {z} FROM daily),
zw AS (SELECT symbol, count(*) AS n, {lists} FROM zr GROUP BY symbol),
rw AS (
  SELECT symbol, n, {names}, 1::BIGINT AS i, {zeros} FROM zw
  UNION ALL SELECT symbol, n, {names}, i + 1, {steps} FROM rw WHERE i < n),
sg AS ({rows}),
gs AS (SELECT symbol, run, idx, open, close, signal FROM sg JOIN daily USING (symbol, idx))"""


def sql_grid(strategy: str, signals_sql: str) -> str:
    combos = search.combinations(strategy)
    defaults = {k: v for k, v in DEFAULTS[strategy].items() if k in combos[0]}
    base = next(search.params_text(p) for p in combos if p == defaults)
    return (
        with_sql(
            SQL_DAILY,
            sql_params(strategy, combos),
            signals_sql,
            sql_backtest("gs", "symbol, run", "gsim"),
            sql_report("gsim", "symbol, run", "grep_"),
        )
        + f""",
sc AS (
  SELECT g.*, params, round(sharpe_ratio, 4) AS score FROM grep_ g JOIN runs USING (run)
  WHERE n_days + 1 >= need),
df AS (SELECT symbol, max(score) AS best, coalesce(max(score) FILTER (WHERE params = '{base}'), 0) AS base
       FROM sc GROUP BY symbol)
SELECT symbol, params, round(sharpe_ratio, 3)::DOUBLE AS sharpe_ratio,
  round(total_return, 4)::DOUBLE AS total_return, round(max_drawdown, 4)::DOUBLE AS max_drawdown,
  round(calmar_ratio, 3)::DOUBLE AS calmar_ratio, round(win_rate, 3)::DOUBLE AS win_rate, n_trades,
  score::DOUBLE AS score,
  row_number() OVER (PARTITION BY symbol ORDER BY score DESC NULLS LAST, run)::INT AS rank,
  base::DOUBLE AS default_score,
  round(CASE WHEN base <> 0 THEN (best - base) / abs(base) * 100 ELSE 0 END, 1)::DOUBLE
    AS improvement_pct
FROM sc JOIN df USING (symbol)"""
    )


for _strategy, _sql in (
    ("mean_reversion", sql_reversion_runs), ("rsi", sql_rsi_runs), ("macd", sql_macd_runs)
):

    def _grid(spark, d, strategy=_strategy):
        return search.grid_search(daily_indexed(spark, d), strategy)

    query(f"grid_search_{_strategy}", sql_grid(_strategy, _sql(search.combinations(_strategy))))(_grid)


def stored_bars(spark, d):
    """Indexed bars, folded once and written, for what reads them several times."""
    return materialize(daily_indexed(spark, d), "bars")


GRID_QUERIES = {n: "grid_search" if n == "momentum" else f"grid_search_{n}" for n in search.SEARCH_GRIDS}


@query(
    "grid_best",
    " UNION ALL ".join(f"SELECT *, '{n}' AS strategy FROM ({ORACLES[q]}) WHERE rank <= 10" for n, q in GRID_QUERIES.items()),
)
def grid_best(spark, d):
    """Ten best runs per symbol and strategy, all four strategies from one table of bars."""
    bars = stored_bars(spark, d)
    parts = [
        search.grid_search(bars, name).filter(F.col("rank") <= 10).withColumn("strategy", F.lit(name))
        for name in search.SEARCH_GRIDS
    ]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query(
    "param_grid",
    with_sql(SQL_DAILY, sql_runs(GRID))
    + """
SELECT symbol, run, params, n > b AS enough_bars
FROM (SELECT symbol, count(*) AS n FROM daily GROUP BY symbol) CROSS JOIN runs""",
)
def param_grid(spark, d):
    counts = daily(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("symbol", "n", F.inline(search.runs_array("momentum", GRID))).select(
        "symbol", "run", "params", (F.col("n") >= F.col("need")).alias("enough_bars")
    )


@query(
    "valid_params",
    """
SELECT p_partkey, s AS strategy, CASE s
    WHEN 'momentum' THEN p_size >= 2 AND floor(p_retailprice / 40) >= 2
                         AND p_size < floor(p_retailprice / 40)
    WHEN 'mean_reversion' THEN p_size >= 2 AND (p_retailprice - 1000) / 100 > 0
    WHEN 'rsi' THEN p_size >= 2 AND p_retailprice / 50 > 0 AND p_retailprice / 50 < p_size * 3
                    AND p_size * 3 < 100
    ELSE p_size >= 2 AND p_size < 26 AND floor(p_retailprice / 400) >= 2 END AS valid
FROM part CROSS JOIN (VALUES ('momentum'), ('mean_reversion'), ('rsi'), ('macd')) v(s)""",
)
def valid_params(spark, d):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    params = F.create_map(
        F.lit("short_window"), size,
        F.lit("long_window"), F.floor(price / 40).cast("double"),
        F.lit("window"), size,
        F.lit("z_threshold"), (price - 1000) / 100,
        F.lit("period"), size,
        F.lit("oversold"), price / 50,
        F.lit("overbought"), size * 3,
        F.lit("fast"), size,
        F.lit("slow"), F.lit(26.0),
        F.lit("signal_period"), F.floor(price / 400).cast("double"),
    )
    names = F.explode(F.array(*[F.lit(s) for s in search.SEARCH_GRIDS])).alias("strategy")
    return (
        table(spark, d, "part")
        .select("p_partkey", params.alias("p"), names)
        .select("p_partkey", "strategy", params_ok(F.col("strategy"), F.col("p")).alias("valid"))
    )


# --- walk-forward ----------------------------------------------------------------------

SPEC = walkforward.Spec()
WF = SPEC.combos

SQL_WINDOWS = """
span AS (SELECT symbol, min(ts)::DATE AS s0, max(ts)::DATE AS e0, count(*) AS n
         FROM daily GROUP BY symbol),
wins0 AS (
  SELECT symbol, k + 1 AS win, (s0 + to_months(3 * k))::DATE AS train_start,
    ((s0 + to_months(3 * k + 12))::DATE - 1)::DATE AS train_end,
    (s0 + to_months(3 * k + 12))::DATE AS test_start,
    ((s0 + to_months(3 * k + 15))::DATE - 1)::DATE AS test_end, e0
  FROM span CROSS JOIN (SELECT unnest(range(0, 400))::INT AS k) WHERE n >= 225),
wins AS (
  SELECT symbol, win, train_start, train_end, test_start, test_end FROM wins0
  WHERE test_end <= e0 QUALIFY count(*) OVER (PARTITION BY symbol) >= 2)"""

SQL_ASSIGN = (
    SQL_WINDOWS
    + """,
asg AS (
  SELECT d.symbol, win, CASE WHEN ts::DATE <= train_end THEN 'train' ELSE 'test' END AS phase,
         ts, open, close
  FROM daily d JOIN wins w ON d.symbol = w.symbol AND ts::DATE BETWEEN train_start AND test_end)"""
)


@query(
    "wf_windows",
    with_sql(SQL_DAILY, SQL_WINDOWS)
    + "SELECT symbol, win::INT AS win, train_start, train_end, test_start, test_end FROM wins",
)
def wf_windows(spark, d):
    return walkforward.windows(daily(spark, d), SPEC)


@query(
    "wf_assign",
    with_sql(SQL_DAILY, SQL_ASSIGN) + "SELECT symbol, win::INT AS win, phase, ts FROM asg",
)
def wf_assign(spark, d):
    return walkforward.assign(daily(spark, d), SPEC).select("symbol", "win", "phase", "ts")


SQL_WF = (
    SQL_DAILY
    + ","
    + SQL_ASSIGN
    + ","
    + sql_runs(WF)
    + """,
good AS (
  SELECT symbol, win FROM asg GROUP BY symbol, win
  HAVING count(*) FILTER (WHERE phase = 'train') >= 30 AND count(*) FILTER (WHERE phase = 'test') >= 5),
tr AS (SELECT *, row_number() OVER (PARTITION BY symbol, win ORDER BY ts) - 1 AS idx
       FROM asg JOIN good USING (symbol, win) WHERE phase = 'train'),
te AS (SELECT *, row_number() OVER (PARTITION BY symbol, win ORDER BY ts) - 1 AS idx
       FROM asg JOIN good USING (symbol, win) WHERE phase = 'test'),"""
    + sql_crossover_runs("tr", "symbol, win", WF, "trs")
    + ","
    + sql_backtest("trs", "symbol, win, run", "trsim")
    + ","
    + sql_report("trsim", "symbol, win, run", "trrep")
    + """,
best AS (
  SELECT symbol, win, run, CASE WHEN n >= greatest(b + 1, 10) THEN round(sharpe_ratio, 10) END
    AS train_score
  FROM trrep JOIN runs USING (run)
  JOIN (SELECT symbol, win, count(*) AS n FROM tr GROUP BY symbol, win) USING (symbol, win)
  QUALIFY row_number() OVER (PARTITION BY symbol, win ORDER BY train_score DESC NULLS LAST, run) = 1),"""
    + sql_crossover_runs("te", "symbol, win", WF, "tes0")
    + """,
tes AS (
  SELECT symbol, win, idx, ts, open, close, params, train_score, n_bars >= greatest(b + 1, 10) AS ok,
         CASE WHEN n_bars >= greatest(b + 1, 10) THEN signal ELSE 0 END AS signal
  FROM tes0 JOIN best USING (symbol, win, run)),"""
    + sql_backtest("tes", "symbol, win", "tesim")
    + ","
    + sql_report("tesim", "symbol, win", "terep")
)


@query(
    "walk_forward",
    with_sql(SQL_WF)
    + """
SELECT symbol, win::INT AS win, train_start, train_end, test_start, test_end,
  params AS best_params, round(train_score, 3)::DOUBLE AS train_sharpe,
  round(sharpe_ratio, 3)::DOUBLE AS test_sharpe, round(total_return, 4)::DOUBLE AS test_return,
  round(max_drawdown, 4)::DOUBLE AS test_max_drawdown, n_trades AS test_n_trades,
  CASE WHEN ok THEN 'ok' ELSE 'short test slice' END AS status
FROM terep JOIN (SELECT DISTINCT symbol, win, params, train_score, ok FROM tes) USING (symbol, win)
JOIN wins USING (symbol, win)""",
)
def walk_forward(spark, d):
    return walkforward.results(daily(spark, d), SPEC)


SQL_STITCH = (
    SQL_WF
    + """,
ends AS (
  SELECT symbol, win, arg_min(equity, idx) AS e0, arg_max(equity, idx) AS e1, any_value(ok) AS ok,
         row_number() OVER (PARTITION BY symbol ORDER BY win) AS rn
  FROM tesim GROUP BY symbol, win),
scales AS (
  SELECT *, exp(coalesce(sum(ln(e1 / e0)) OVER (PARTITION BY symbol ORDER BY win
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    * first_value(e0) OVER (PARTITION BY symbol ORDER BY win) / e0 AS scale
  FROM ends),
stitched AS (
  SELECT symbol, win, idx, ts, equity * scale AS stitched
  FROM tesim JOIN scales s USING (symbol, win)
  WHERE (rn = 1 AND idx = 0) OR (s.ok AND (idx > 0)))"""
)


@query(
    "wf_stitch",
    with_sql(SQL_STITCH)
    + "SELECT symbol, win::INT AS win, idx, ts, round(stitched, 3) AS stitched FROM stitched",
)
def wf_stitch(spark, d):
    out = walkforward.stitch(walkforward.evaluate(daily(spark, d), SPEC))
    return out.withColumn("stitched", F.round("stitched", 3))


@query(
    "wf_summary",
    with_sql(SQL_STITCH)
    + """,
mean AS (
  SELECT symbol, avg(round(train_score, 3)) AS i, avg(round(sharpe_ratio, 3)) AS o, count(*) AS n
  FROM terep JOIN best USING (symbol, win) GROUP BY symbol),
ratio AS (SELECT *, CASE WHEN abs(i) < 0.01 THEN 0 ELSE o / i END AS r FROM mean),
pk AS (SELECT *, max(stitched) OVER (PARTITION BY symbol ORDER BY win, idx) AS peak FROM stitched),
cv AS (SELECT symbol, arg_max(stitched, (win, idx)) / arg_min(stitched, (win, idx)) - 1 AS cr,
              max((peak - stitched) / peak) AS md FROM pk GROUP BY symbol)
SELECT symbol, round(i, 3) AS in_sample_sharpe, round(o, 3) AS out_of_sample_sharpe,
  round(r, 3)::DOUBLE AS robustness_ratio,
  CASE WHEN r >= 0.7 THEN 'ROBUST' WHEN r >= 0.4 THEN 'MODERATE' ELSE 'OVERFITTED' END AS verdict,
  n AS n_windows, round(cr, 4) AS combined_return, round(md, 4) AS combined_max_drawdown
FROM ratio JOIN cv USING (symbol)""",
)
def wf_summary(spark, d):
    return walkforward.summary(daily(spark, d), SPEC)


def sql_walk_forward(strategy: str, runs_sql) -> str:
    """Every slice of a window is a series of its own; all runs are simulated on all slices, and the
    best one of the training slice is read off the test slice."""
    combos = walkforward.Spec(strategy=strategy).combos
    return (
        with_sql(SQL_DAILY, SQL_ASSIGN, sql_params(strategy, combos))
        + f""",
good AS (
  SELECT symbol, win FROM asg GROUP BY symbol, win
  HAVING count(*) FILTER (WHERE phase = 'train') >= 30 AND count(*) FILTER (WHERE phase = 'test') >= 5),
slices AS (
  SELECT symbol || '|' || win || '|' || phase AS symbol, ts, open, close, symbol AS brand, win, phase,
    row_number() OVER (PARTITION BY symbol, win, phase ORDER BY ts) - 1 AS idx,
    count(*) OVER (PARTITION BY symbol, win, phase) AS n
  FROM asg JOIN good USING (symbol, win)),
every AS (
  WITH RECURSIVE daily AS (SELECT symbol, ts, open, close, idx FROM slices), {runs_sql(combos)}
  SELECT symbol, run, idx, open, close, signal FROM gs),
sized AS (
  SELECT e.symbol, e.run, e.idx, e.open, e.close, CASE WHEN n >= greatest(need, 10) THEN signal ELSE 0 END AS signal
  FROM every e JOIN runs USING (run) JOIN (SELECT symbol, max(n) AS n FROM slices GROUP BY symbol) USING (symbol)),
{sql_backtest("sized", "symbol, run", "wsim").strip()},
{sql_report("wsim", "symbol, run", "wrep").strip()},
told AS (
  SELECT w.*, brand, win, phase, params, n >= greatest(need, 10) AS ok,
    CASE WHEN n >= greatest(need, 10) THEN round(sharpe_ratio, 10) END AS score
  FROM wrep w JOIN runs USING (run) JOIN (SELECT DISTINCT symbol, brand, win, phase, n FROM slices) USING (symbol)),
best AS (
  SELECT brand, win, run, score AS train_score FROM told WHERE phase = 'train'
  QUALIFY row_number() OVER (PARTITION BY brand, win ORDER BY score DESC NULLS LAST, run) = 1)
SELECT t.brand AS symbol, t.win::INT AS win, train_start, train_end, test_start, test_end, params AS best_params,
  round(train_score, 3)::DOUBLE AS train_sharpe, round(sharpe_ratio, 3)::DOUBLE AS test_sharpe,
  round(total_return, 4)::DOUBLE AS test_return, round(max_drawdown, 4)::DOUBLE AS test_max_drawdown,
  n_trades AS test_n_trades, CASE WHEN ok THEN 'ok' ELSE 'short test slice' END AS status
FROM told t JOIN best USING (brand, win, run) JOIN wins w ON w.symbol = t.brand AND w.win = t.win
WHERE phase = 'test'"""
    )


for _strategy, _sql in (("mean_reversion", sql_reversion_runs), ("rsi", sql_rsi_runs), ("macd", sql_macd_runs)):

    def _wf(spark, d, strategy=_strategy):
        return walkforward.results(daily(spark, d), walkforward.Spec(strategy=strategy))

    query(f"walk_forward_{_strategy}", sql_walk_forward(_strategy, _sql))(_wf)


# --- ranges ----------------------------------------------------------------------------


def lookbacks(bars):
    """One range per bar, ending there and reaching back by a length read from the data."""
    back = F.pmod(F.col("volume").cast("long"), F.lit(200))
    return bars.select(
        "symbol", F.greatest(F.col("idx") - back, F.lit(0)).alias("l"), F.col("idx").alias("r")
    )


SQL_LOOKBACKS = """
q AS (SELECT symbol, greatest(idx - volume::BIGINT % 200, 0) AS l, idx AS r FROM daily)"""


@query(
    "range_minmax",
    with_sql(SQL_DAILY, SQL_LOOKBACKS)
    + """
SELECT q.symbol, l, r, max(high) AS resistance, min(low) AS support
FROM q JOIN daily d ON d.symbol = q.symbol AND d.idx BETWEEN l AND r GROUP BY q.symbol, l, r""",
)
def range_minmax(spark, d):
    bars = stored_bars(spark, d)
    out = ranges.range_extremes(bars, lookbacks(bars))
    return out.withColumnsRenamed({"hi": "resistance", "lo": "support"})


@query(
    "range_agg",
    with_sql(SQL_DAILY, SQL_LOOKBACKS)
    + """
SELECT q.symbol, l, r, max(close) AS hi, min(close) AS lo, sum(volume) AS total
FROM q JOIN daily d ON d.symbol = q.symbol AND d.idx BETWEEN l AND r GROUP BY q.symbol, l, r""",
)
def range_agg(spark, d):
    bars = stored_bars(spark, d)
    stored = ranges.blocks(bars, "close", "close", "volume")
    return ranges.answer(stored, lookbacks(bars)).select("symbol", "l", "r", "hi", "lo", "total")


@query(
    "range_after_update",
    with_sql(SQL_DAILY, SQL_LOOKBACKS)
    + """,
upd AS (
  SELECT p_brand AS symbol, l_shipdate AS ts,
    arg_max(100 + l_extendedprice / l_quantity / 1000,
            (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL),
fixed AS (SELECT d.symbol, idx, coalesce(value, close) AS v FROM daily d LEFT JOIN upd USING (symbol, ts))
SELECT q.symbol, l, r, max(v) AS hi, min(v) AS lo
FROM q JOIN fixed f ON f.symbol = q.symbol AND f.idx BETWEEN l AND r GROUP BY q.symbol, l, r""",
)
def range_after_update(spark, d):
    bars = stored_bars(spark, d)
    returned = (
        table(spark, d, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .join(
            table(spark, d, "part").select("p_partkey", "p_brand"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
        .select(
            F.col("p_brand").alias("symbol"),
            F.col("l_shipdate").alias("ts"),
            index_price().alias("value"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("version"),
        )
    )
    stored = ranges.updated(ranges.blocks(bars, "close", "close"), bars, returned, F.col("version"))
    return ranges.answer(stored, lookbacks(bars)).drop("total")


# --- what-if ---------------------------------------------------------------------------

SHOCKS = [-0.2, -0.1, 0.1, 0.2]


@query(
    "shock_recovery",
    with_sql(SQL_DAILY)
    + """,
m AS (SELECT symbol, idx, close, lag(close) OVER (PARTITION BY symbol ORDER BY idx) AS pre FROM daily),
h AS (SELECT symbol, idx, pre, t FROM m CROSS JOIN (VALUES (-0.2::DOUBLE), (-0.1::DOUBLE),
        (0.1::DOUBLE), (0.2::DOUBLE)) v(t)
      WHERE CASE WHEN t < 0 THEN close / pre - 1 < t ELSE close / pre - 1 > t END),
rec AS (
  SELECT h.symbol, h.idx, t, min(m.idx - h.idx + 1) AS days
  FROM h LEFT JOIN m ON m.symbol = h.symbol AND m.idx BETWEEN h.idx AND h.idx + 88
    AND CASE WHEN t < 0 THEN m.close >= h.pre ELSE m.close <= h.pre END
  GROUP BY h.symbol, h.idx, t),
agg AS (SELECT symbol, t, count(*) AS occurrences, avg(days) AS days FROM rec GROUP BY symbol, t)
SELECT s.symbol, v.t AS threshold, coalesce(occurrences, 0) AS occurrences,
       round(coalesce(days, 0), 6) AS avg_recovery
FROM (SELECT DISTINCT symbol FROM daily) s CROSS JOIN (VALUES (-0.2::DOUBLE), (-0.1::DOUBLE),
     (0.1::DOUBLE), (0.2::DOUBLE)) v(t) LEFT JOIN agg ON agg.symbol = s.symbol AND agg.t = v.t""",
)
def shock_recovery(spark, d):
    bars = daily_indexed(spark, d)
    levels = F.explode(F.array(*[F.lit(s) for s in SHOCKS])).alias("threshold")
    shocks = table(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct()
    out = whatif.shock_recovery(bars, shocks.select("symbol", levels))
    return out.withColumn("avg_recovery", F.round("avg_recovery", 6))


WHATIF_PERIODS = {
    "covid": ("1997-02-01", "1997-12-31"),
    "2022_bear": ("1999-01-01", "1999-12-31"),
    "2008": ("1996-09-01", "1997-03-31"),
}
WHATIF_DEFAULT = ("1998-01-01", "2000-12-31")


def whatif_questions(spark, d):
    sizes = table(spark, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(
        F.max("p_size").alias("n")
    )
    asks = F.array(
        F.format_string("What if it falls and prices drop %d%%?", "n"),
        F.format_string("What happens if it should jump %d%% tomorrow", F.col("n") * 2),
        F.lit("How would it do in another 2008 financial crisis?"),
        F.lit("Covid again"),
        F.lit("is it any good?"),
    )
    return sizes.select("symbol", F.explode(asks).alias("question"))


def _sql_period(name: str) -> str:
    a, b = dict(WHATIF_PERIODS, default=WHATIF_DEFAULT)[name]
    return (
        f"SELECT symbol, '{name}' AS period, ts, open, close FROM daily "
        f"WHERE ts >= DATE '{a}' AND ts < DATE '{b}'"
    )


@query(
    "what_if",
    with_sql(
        SQL_DAILY,
        "pers AS ("
        + " UNION ALL ".join(_sql_period(n) for n in ("covid", "2008", "default"))
        + """),
pi AS (SELECT *, row_number() OVER (PARTITION BY symbol, period ORDER BY ts) - 1 AS idx FROM pers
       QUALIFY count(*) OVER (PARTITION BY symbol, period) >= 51)""",
        sql_momentum("pi", 20, 50, "symbol, period", "psig"),
        sql_backtest("psig", "symbol, period", "psim"),
        sql_report("psim", "symbol, period", "prep"),
    )
    + f""",
sz AS (SELECT p_brand AS symbol, max(p_size) AS n FROM part GROUP BY p_brand),
qs AS (
  SELECT symbol, 'What if it falls and prices drop ' || n || '%?' AS question, -n::DOUBLE AS shock,
         NULL AS period FROM sz
  UNION ALL SELECT symbol, 'What happens if it should jump ' || (n * 2) || '% tomorrow',
         (n * 2)::DOUBLE, NULL FROM sz
  UNION ALL SELECT symbol, 'How would it do in another 2008 financial crisis?', NULL, '2008' FROM sz
  UNION ALL SELECT symbol, 'Covid again', NULL, 'covid' FROM sz
  UNION ALL SELECT symbol, 'is it any good?', -10, NULL FROM sz),
rec0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ix FROM daily
         QUALIFY ts > max(ts) OVER (PARTITION BY symbol) - INTERVAL 5 YEAR),
m AS (SELECT symbol, ix, close, lag(close) OVER (PARTITION BY symbol ORDER BY ix) AS pre FROM rec0),
th AS (SELECT DISTINCT symbol, coalesce(shock, -5) / 100 AS t FROM qs),
h AS (SELECT symbol, ix, pre, t FROM m JOIN th USING (symbol)
      WHERE CASE WHEN t < 0 THEN close / pre - 1 < t ELSE close / pre - 1 > t END),
rc AS (
  SELECT h.symbol, h.ix, t, min(m.ix - h.ix + 1) AS days
  FROM h LEFT JOIN m ON m.symbol = h.symbol AND m.ix BETWEEN h.ix AND h.ix + 88
    AND CASE WHEN t < 0 THEN m.close >= h.pre ELSE m.close <= h.pre END
  GROUP BY h.symbol, h.ix, t),
occ AS (SELECT symbol, t, count(*) AS n, coalesce(avg(days), 0) AS days FROM rc GROUP BY symbol, t),
ans AS (
  SELECT q.symbol, question, shock, q.period, coalesce(total_return, 0) AS ret,
    coalesce(sharpe_ratio, 0)::DOUBLE AS new_sharpe,
    coalesce(n, 0) AS n, coalesce(days, 0) AS days,
    CASE WHEN coalesce(total_return, 0) > 0.05 THEN 'BUY'
         WHEN coalesce(total_return, 0) < -0.05 THEN 'SELL' ELSE 'HOLD' END AS sig
  FROM qs q LEFT JOIN prep p ON p.symbol = q.symbol AND p.period = coalesce(q.period, 'default')
  LEFT JOIN occ ON occ.symbol = q.symbol AND occ.t = coalesce(shock, -5) / 100)
SELECT symbol, question,
  CASE WHEN period IS NULL THEN 'price_shock' ELSE 'historical_period' END AS scenario_type,
  CASE period WHEN 'covid' THEN symbol || ' during 1997-02-01 to 1997-12-31'
    WHEN '2008' THEN symbol || ' during 1996-09-01 to 1997-03-31'
    ELSE printf('%+.1f%%', shock) || CASE WHEN shock < 0 THEN ' price drop in ' ELSE ' price rise in ' END
         || symbol END AS scenario_description,
  CASE WHEN sig <> 'HOLD' THEN 'HOLD -> ' || sig END AS signal_change, sig AS new_signal,
  round(coalesce(shock, ret * 100), 2)::DOUBLE AS price_impact,
  round(new_sharpe - 0.5, 3)::DOUBLE AS sharpe_impact, round(new_sharpe, 3) AS new_sharpe, n AS historical_occurrences,
  CASE WHEN days > 0 THEN round(days, 1) END AS avg_recovery_days,
  trim('Under this scenario, the momentum strategy '
    || CASE WHEN sig <> 'HOLD' THEN 'signal changes from HOLD to ' ELSE 'signal remains ' END || sig
    || '. Price impact: ' || printf('%+.1f%%', coalesce(shock, ret * 100)) || ', Sharpe: '
    || printf('%.2f', new_sharpe) || '. '
    || CASE WHEN n > 0 THEN 'This occurred ' || n || ' times in 5 years.' ELSE '' END || ' '
    || CASE WHEN days > 0 THEN 'Historically recovered in ~' || printf('%.0f', days) || ' days.'
            ELSE '' END) AS explanation
FROM ans""",
)
def what_if(spark, d):
    return whatif.what_if(
        daily(spark, d),
        whatif_questions(spark, d),
        periods=WHATIF_PERIODS,
        default_period=WHATIF_DEFAULT,
    )
