import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import alerts, ranges
from barloom.operators.series import BY_SYMBOL, index_rows
from barloom.plans import backtest, search, walkforward, whatif
from barloom.plugins import register_pandas_strategy, register_strategy
from barloom.operators import signals


def bars(spark, n=400, symbols=("A", "B"), start="2020-01-31"):
    rng = random.Random(1)
    rows = []
    for s in symbols:
        x = 100.0
        day = dt.datetime.fromisoformat(start)
        for _ in range(n):
            o = x * (1 + rng.gauss(0, 0.004))
            x *= 1 + rng.gauss(0.0005, 0.02)
            rows.append((s, day, o, max(o, x) * 1.01, min(o, x) * 0.99, x, 1000.0))
            day += dt.timedelta(days=1)
    return spark.createDataFrame(
        rows,
        "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double",
    )


@pytest.mark.parametrize("strategy", list(search.SEARCH_GRIDS))
def test_grid_rows_equal_single_runs(spark, strategy):
    df = index_rows(bars(spark, 200), BY_SYMBOL).cache()
    grid = {k: v[:2] for k, v in search.SEARCH_GRIDS[strategy].items()}
    got = {
        (r["symbol"], r["params"]): r for r in search.grid_search(df, strategy, grid).collect()
    }
    combos = search.combinations(strategy, grid)
    assert len(got) == 2 * len(combos)
    for p in combos[-1:]:
        for r in backtest.run(df, strategy, p, rounded=False).collect():
            row = got[r["symbol"], search.params_text(p)]
            assert row["sharpe_ratio"] == pytest.approx(r["sharpe_ratio"], abs=6e-4)
            assert row["n_trades"] == r["n_trades"]
    best = [r for r in got.values() if r["rank"] == 1]
    assert all(r["score"] == max(x["score"] for x in got.values() if x["symbol"] == r["symbol"]) for r in best)


def test_window_dates_clamp_month_ends(spark):
    rows = walkforward.windows(
        bars(spark, 800, ["A"]), walkforward.Spec(train_months=1, test_months=1, step_months=1)
    ).orderBy("win").collect()
    assert str(rows[0]["train_start"]) == "2020-01-31"
    assert str(rows[0]["train_end"]) == "2020-02-28"
    assert str(rows[1]["train_start"]) == "2020-02-29"
    assert str(rows[2]["train_start"]) == "2020-03-31"
    assert all(r["test_end"] <= dt.date(2020, 1, 31) + dt.timedelta(days=799) for r in rows)


def test_walk_forward_picks_the_best_training_run(spark):
    data = bars(spark, 500, ["A"])
    spec = walkforward.Spec(train_months=6, test_months=3, step_months=3)
    rows = walkforward.results(data, spec).orderBy("win").collect()
    assert len(rows) >= 2
    for r in rows[:1]:
        cut = data.filter(F.to_date("ts").between(r["train_start"], r["train_end"]))
        reports = []
        for p in spec.combos:
            one = backtest.run(index_rows(cut, BY_SYMBOL), "momentum", p, rounded=False).first()
            reports.append((one["sharpe_ratio"], search.params_text(p)))
        best = max(s for s, _ in reports)
        assert r["train_sharpe"] == pytest.approx(best, abs=6e-4)
        assert r["best_params"] == next(t for s, t in reports if abs(s - best) < 1e-9)
    assert walkforward.windows(bars(spark, 100, ["A"]), spec).count() == 0


@pytest.mark.parametrize("rows", [7, 128])
def test_ranges_equal_brute_force(spark, monkeypatch, rows):
    rng = random.Random(2)
    monkeypatch.setattr(ranges, "BLOCK_ROWS", rows)
    vals = [rng.uniform(50, 200) for _ in range(300)]
    df = spark.createDataFrame(
        [("A", i, v) for i, v in enumerate(vals)], "symbol string, idx long, v double"
    )
    asks = {(a, b) for a, b in (sorted((rng.randrange(300), rng.randrange(300))) for _ in range(200))}
    asks |= {(0, 299), (0, 0), (299, 299)}
    q = spark.createDataFrame([("A", a, b) for a, b in asks], "symbol string, l long, r long")
    out = ranges.answer(ranges.blocks(df, "v", "v"), q).collect()
    assert len(out) == len(asks)
    for r in out:
        part = vals[r["l"] : r["r"] + 1]
        assert (r["hi"], r["lo"]) == (max(part), min(part))
        assert r["total"] == pytest.approx(sum(part))
    for bad in (("A", 5, 4), ("A", -1, 3), ("A", 290, 300), ("A", 300, 330), ("B", 0, 1)):
        q = spark.createDataFrame([bad], "symbol string, l long, r long")
        for ask in (lambda: ranges.range_extremes(df, q, "v", "v"), lambda: ranges.range_sums(df, q, "v")):
            with pytest.raises(Exception, match="bad range"):
                ask().collect()


def test_updates_touch_known_points_only(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK_ROWS", 4)
    rows = [("A", 100 + i, i, float(i)) for i in range(11)] + [("B", 100, 0, 5.0)]
    df = spark.createDataFrame(rows, "symbol string, ts long, idx long, v double")
    stored = ranges.blocks(df, "v", "v")
    schema = "symbol string, ts long, value double, n int"
    new = spark.createDataFrame([("A", 102, 50.0, 1), ("A", 102, 70.0, 2), ("A", 109, -1.0, 1)], schema)
    fixed = ranges.updated(stored, df, new, F.col("n"))
    asks = spark.createDataFrame([("A", 0, 10), ("A", 3, 10), ("A", 2, 2), ("B", 0, 0)], "symbol string, l long, r long")
    got = {(r.symbol, r.l): (r.hi, r.lo, r.total) for r in ranges.answer(fixed, asks).collect()}
    assert got == {("A", 0): (70.0, -1.0, 55 - 2 + 70 - 9 - 1), ("A", 3): (10.0, -1.0, 52 - 9 - 1), ("A", 2): (70.0, 70.0, 70.0), ("B", 0): (5.0, 5.0, 5.0)}
    new = spark.createDataFrame([("A", 300, 5.0, 1)], schema)
    with pytest.raises(Exception, match="unknown point"):
        ranges.updated(stored, df, new, F.col("n")).collect()


def test_first_reach_equals_a_scan(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK_ROWS", 8)
    rng = random.Random(5)
    vals = [rng.uniform(0, 100) for _ in range(90)]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(vals)], "symbol string, idx long, v double")
    asks = [("A", rng.randrange(90), rng.uniform(-5, 105), rng.random() < 0.5) for _ in range(150)]
    starts = spark.createDataFrame(asks, "symbol string, idx long, level double, up boolean")
    for reach in (0, 5, 30):
        got = sorted(map(str, ranges.first_reach(ranges.blocks(df, "v", "v"), starts, reach).collect()))
        want = []
        for s, i, level, up in asks:
            near = [k for k, v in enumerate(vals[i : i + reach + 1]) if (v >= level if up else v <= level)]
            want.append((s, i, level, up, near[0] if near else None))
        assert got == sorted(map(str, spark.createDataFrame(want, "symbol string, idx long, level double, up boolean, after long").collect()))


@pytest.mark.parametrize(
    "text, period, shock",
    [
        ("What if it drops 20%?", None, -10.0),
        ("what if prices drop 20%", None, -20.0),
        ("a RALLY 7.5 % please", None, 7.5),
        ("another pandemic", "covid", None),
        ("the 2022 crash", "2022_bear", None),
        ("like 2008", "2008", None),
        ("hm", None, -10.0),
    ],
)
def test_scenarios(spark, text, period, shock):
    row = spark.createDataFrame([(text,)], "q string").select(
        *[c.alias(n) for n, c in whatif.detect(F.col("q")).items()]
    ).first()
    assert (row["period"], row["shock"]) == (period, shock)


def test_alert_registry(spark):
    log = [
        ("A", "price_above", "add", 1.0, "", 1),
        ("A", "price_above", "add", 2.0, "n", 2),
        ("A", "price_below", "add", 1.0, "", 3),
        ("A", "price_below", "remove", None, "", 4),
        ("B", "price_below", "add", 1.0, "", 5),
        ("B", "", "remove_all", None, "", 6),
        ("C", "price_below", "remove", None, "", 7),
        ("C", "price_below", "add", 9.0, "", 8),
    ]
    df = spark.createDataFrame(
        log, "symbol string, condition string, action string, threshold double, note string, seq int"
    )
    rows = {(r[0], r[1], r[2]) for r in alerts.registry(df).collect()}
    assert rows == {("A", "price_above", 2.0), ("C", "price_below", 9.0)}


def test_plugged_strategies(spark):
    register_strategy(
        "always", lambda df, layout, **p: df.withColumn("signal", F.lit(p["side"])), {"side": 1}
    )
    register_pandas_strategy("alternate", lambda b, p: [1 if i % 2 else -1 for i in range(len(b))], {})
    try:
        df = index_rows(bars(spark, 30, ["A"]), BY_SYMBOL)
        assert backtest.run(df, "always").first()["n_trades"] == 0
        assert backtest.run(df, "alternate").first()["n_trades"] > 5
    finally:
        for n in ("always", "alternate"):
            signals.GENERATORS.pop(n)
            signals.DEFAULTS.pop(n)
