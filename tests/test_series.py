import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import recurrence, rolling, signals
from barloom.operators.series import BY_SYMBOL, blocked, index_rows, running
from barloom.plans import backtest
from tests import loops

SMALL = blocked(rows=8, span_seconds=40)


def frame(spark, series, name="close"):
    rows = [(s, i * 10, float(v)) for s, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, f"symbol string, at long, {name} double")
    return df.withColumn("ts", F.timestamp_seconds("at").cast("timestamp_ntz")).drop("at")


def column(df, name, symbol="A"):
    return columns(df, name).get(symbol, [])


def columns(df, name):
    """Values per symbol in series order, from one action."""
    got = {}
    for r in sorted(df.select("symbol", "idx", name).collect(), key=lambda r: (r[0], r[1])):
        got.setdefault(r[0], []).append(r[2])
    return got


@pytest.fixture(scope="module")
def walk():
    rng = random.Random(3)
    hot, x = [], 100.0
    for _ in range(150):
        x *= 1 + rng.gauss(0, 0.03)
        hot.append(x)
    return {"A": hot, "B": hot[:5], "C": [7.0]}


@pytest.mark.parametrize("size", [2, 20])
def test_blocked_windows_equal_whole_windows(spark, walk, size):
    df = frame(spark, walk)
    for op in (
        lambda d, lay: rolling.rolling_mean(d, size, out="v", layout=lay),
        lambda d, lay: rolling.online_stats(d, max(size, 2), layout=lay).withColumn("v", F.col("std")),
        lambda d, lay: rolling.simple_returns(d, out="v", layout=lay),
        lambda d, lay: rolling.zscore(d, max(size, 2), out="v", layout=lay),
        lambda d, lay: rolling.rolling_max_drawdown(d, size, out="v", layout=lay),
    ):
        a = column(op(index_rows(df, BY_SYMBOL), BY_SYMBOL), "v")
        b = column(op(index_rows(df, SMALL), SMALL), "v")
        assert len(a) == len(b) == 150
        assert all(loops.close_to(x, y) for x, y in zip(a, b))


def test_blocked_running_values(spark, walk):
    df = frame(spark, walk)
    kinds = {
        "total": ("sum", F.col("close")),
        "peak": ("max", F.col("close")),
        "low": ("min", F.col("close")),
        "base": ("first", F.col("close")),
        "seen": ("last", F.when(F.col("close") > 100, F.col("close"))),
    }
    a = running(index_rows(df, BY_SYMBOL), BY_SYMBOL, **kinds)
    b = running(index_rows(df, SMALL), SMALL, **kinds)
    for name in kinds:
        whole, cut = columns(a, name), columns(b, name)
        for s in "ABC":
            assert all(loops.close_to(x, y) for x, y in zip(whole[s], cut[s]))


def test_small_literals(spark):
    d = index_rows(frame(spark, {"A": [1, 2, 3, 4, 5]}), BY_SYMBOL)
    assert column(rolling.rolling_mean(d, 3), "sma") == [None, None, 2, 3, 4]
    with pytest.raises(ValueError):
        rolling.rolling_mean(d, 0)
    with pytest.raises(ValueError):
        rolling.rolling_std(d, 1)


@pytest.mark.parametrize("span", [1, 12, 200])
def test_ema_over_many_blocks(spark, walk, span):
    long = walk["A"] * 8
    df = index_rows(frame(spark, {"A": long, "B": walk["B"]}), BY_SYMBOL)
    out = recurrence.ema(df, {"e": span})
    for s, xs in (("A", long), ("B", walk["B"])):
        assert all(loops.close_to(x, y) for x, y in zip(column(out, "e", s), loops.ema(xs, span)))


def test_macd_and_shared_lines(spark, walk):
    xs = walk["A"] * 20
    df = index_rows(frame(spark, {"A": xs}), BY_SYMBOL)
    line = [a - b for a, b in zip(loops.ema(xs, 12), loops.ema(xs, 26))]
    want = [a - b for a, b in zip(line, loops.ema(line, 9))]
    got = column(recurrence.macd(df), "hist")
    many = column(recurrence.macd_lines(df, {(12, 26, 9): "h", (8, 21, 7): "g"}), "h")
    assert all(loops.close_to(x, y, 1e-8) for x, y in zip(got, want))
    assert all(loops.close_to(x, y, 1e-8) for x, y in zip(many, want))


def test_rsi_with_flat_stretches_and_many_blocks(spark, walk):
    xs = walk["A"] * 12 + [50.0] * 900 + walk["A"]
    series = {"A": xs, "B": [5.0] * 40, "C": [1, 2, 3, 4, 5, 6.0]}
    df = frame(spark, series)
    got = recurrence.rsi(index_rows(df, BY_SYMBOL), 3)
    seen = columns(got, "rsi")
    for s, v in series.items():
        assert all(loops.close_to(x, y, 1e-7) for x, y in zip(seen[s], loops.rsi(v, 3)))
    cut = recurrence.rsi(index_rows(df, SMALL), 3, layout=SMALL)
    assert all(loops.close_to(x, y, 1e-7) for x, y in zip(column(cut, "rsi"), loops.rsi(xs, 3)))


def test_reversion_automaton_equals_loop(spark):
    rng = random.Random(11)
    series = {}
    for k in range(60):
        scale = rng.choice([0.5, 1.5, 3])
        series[f"S{k}"] = [
            None if rng.random() < 0.1 else 0.0 if rng.random() < 0.1 else rng.gauss(0, scale)
            for _ in range(rng.randint(1, 60))
        ]
    rows = [(s, i, z) for s, zs in series.items() for i, z in enumerate(zs)]
    df = spark.createDataFrame(rows, "symbol string, idx long, z double")
    for leave in (0.0, 0.4, -0.4, 1.0, -1.0, 1.3, -2.5):
        out = signals.reversion_signals(df, 3, 1.0, leave, BY_SYMBOL)
        got = {}
        for r in out.orderBy("symbol", "idx").collect():
            got.setdefault(r["symbol"], []).append(r["signal"])
        for s, zs in series.items():
            assert got[s] == loops.reversion(zs, 3, 1.0, leave), (s, zs)
    # composed in blocks of seven bars, and with a threshold per row
    lay = blocked(rows=7)
    for limit in (1.0, F.when(F.col("symbol") < "S4", 1.0).otherwise(0.5)):
        out = signals.reversion_signals(df, 3, limit, 1.3, lay)
        got = columns(out, "signal")
        for s, zs in series.items():
            enter = 1.0 if isinstance(limit, float) or s < "S4" else 0.5
            assert got[s] == loops.reversion(zs, 3, enter, 1.3), (s, zs)


def test_mixed_spans_copy_no_row(spark, walk):
    xs = walk["A"] * 25
    df = frame(spark, {"A": xs, "B": walk["B"]})
    spans = {"a": 2, "b": 26, "c": 200, "d": 1}
    assert len(recurrence.block_classes([recurrence.alpha_of(s) for s in spans.values()])) == 2
    for lay in (BY_SYMBOL, blocked(rows=64, span_seconds=400)):
        out = recurrence.ema(index_rows(df, lay), spans, layout=lay)
        assert out.count() == len(xs) + 5
        for name, span in spans.items():
            assert all(loops.close_to(x, y) for x, y in zip(column(out, name), loops.ema(xs, span)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def drawdown(xs, size):
    out = []
    for i in range(len(xs)):
        peak, worst = 0.0, 0.0
        for x in xs[max(0, i - size + 1) : i + 1]:
            peak = max(peak, x)
            worst = max(worst, (peak - x) / peak if peak > 0 else 0.0)
        out.append(worst if i >= size - 1 else None)
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 20, 150, 151])
def test_rolling_drawdown_equals_loop(spark, walk, size):
    xs = walk["A"] + [0.0, 0.0, 3.0, 0.0] + walk["A"][::-1]
    df = frame(spark, {"A": xs, "B": walk["B"]})
    for lay in (BY_SYMBOL, SMALL):
        out = rolling.rolling_max_drawdown(index_rows(df, lay), size, layout=lay)
        assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = columns(out, "mdd")
        for s, v in (("A", xs), ("B", walk["B"])):
            assert all(loops.close_to(x, y) for x, y in zip(got[s], drawdown(v, size))), (s, size)


@pytest.mark.parametrize("long_only", [True, False])
@pytest.mark.parametrize("size", [1.0, 0.4])
def test_simulation_equals_loop(spark, long_only, size):
    rng = random.Random(5)
    series, rows = {}, []
    for k in range(40):
        n = rng.randint(1, 50)
        bars = [
            (rng.uniform(50, 200), rng.uniform(50, 200), rng.choice([-1, 0, 0, 1])) for _ in range(n)
        ]
        series[f"S{k}"] = bars
        rows += [(f"S{k}", i, *b) for i, b in enumerate(bars)]
    df = spark.createDataFrame(
        rows, "symbol string, idx long, open double, close double, signal int"
    )
    out = backtest.simulate(df, position_size=size, long_only=long_only)
    equities, gains = columns(out, "equity"), columns(out, "trade_ret")
    for s, bars in series.items():
        o, c, g = zip(*bars)
        equity, trades = loops.backtest(o, c, g, size, long_only=long_only)
        assert all(loops.close_to(x, y, 1e-8) for x, y in zip(equities[s], equity))
        made = [t for t in gains[s] if t is not None]
        assert len(made) == len(trades)
        assert all(loops.close_to(x, y, 1e-8) for x, y in zip(made, trades))


def test_a_total_loss_leaves_nothing(spark):
    bars = [(100.0, 100.0, 1), (100.0, 90.0, -1), (0.0, 0.0, 1), (50.0, 60.0, 0), (60.0, 70.0, -1), (80.0, 80.0, 0)]
    rows = [("A", i, *b) for i, b in enumerate(bars)]
    df = spark.createDataFrame(rows, "symbol string, idx long, open double, close double, signal int")
    got = columns(backtest.simulate(df), "equity")["A"]
    want, _ = loops.backtest(*zip(*bars))
    assert got[2:] == [0.0] * 4 and all(loops.close_to(x, y) for x, y in zip(got, want))
