import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.streaming import alerting, live, tables, windows
from barloom.streaming.keyed import Average, Indicators, Macd, MeanReversion, Rsi, keyed_state
from tests import loops

START = dt.datetime(2024, 1, 1)


def land(spark, path, ticks, name):
    rows = [(i, START + dt.timedelta(minutes=m), 1, "A", p, "{}") for i, m, p in ticks]
    spark.createDataFrame(
        rows,
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def stream(spark, path):
    schema = spark.read.parquet(f"{path}/one").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    return rows.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq"),
    )


def test_restart_and_late_rows(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    land(spark, src, [(1, 5, 10.0), (2, 50, 12.0), (3, 70, 11.0), (4, 200, 9.0)], "one")
    run = lambda: tables.finish(
        tables.start_append(windows.plain(windows.candles(stream(spark, src), delay="0 seconds")), out, state)
    )
    run()
    first = spark.read.parquet(out).orderBy("ts").collect()
    assert [(r["open"], r["close"]) for r in first] == [(10.0, 12.0), (11.0, 11.0)]
    # After a restart the watermark is kept: the late row at minute 6 is dropped.
    land(spark, src, [(5, 6, 99.0), (6, 210, 8.0), (7, 400, 7.0)], "two")
    run()
    rows = spark.read.parquet(out).orderBy("ts").collect()
    assert [(r["high"], r["low"]) for r in rows] == [(12.0, 10.0), (11.0, 11.0), (9.0, 8.0)]


def test_unordered_part_files_lose_no_tick(spark, tmp_path):
    """A table of part files in no order, one per micro-batch, equals the batch fold."""
    rng = random.Random(4)
    ticks = [(i, rng.randrange(60 * 24 * 40), rng.uniform(50, 90)) for i in range(900)]
    src = str(tmp_path / "table")
    for n in range(3):
        rows = [(i, START + dt.timedelta(minutes=m), 1, "AB"[i % 2], p, "{}") for i, m, p in ticks[n::3]]
        df = spark.createDataFrame(rows, tables.EVENTS).coalesce(1)
        df.write.mode("append").parquet(f"{src}/events.parquet")
    feed = tables.tick_stream(spark, src, files_per_batch=1)
    changes = tables.drain_changes(windows.plain(windows.candles(feed, delay="3650 days")), "parts")
    assert changes.select(tables.BATCH).distinct().count() == 3
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in tables.current(changes, ["symbol", "ts"]).collect()}
    want = {}
    for i, m, p in sorted(ticks, key=lambda t: (t[1], t[0])):
        key = ("AB"[i % 2], START + dt.timedelta(hours=m // 60))
        o, h, lo, _, v = want.get(key, (p, p, p, p, 0.0))
        want[key] = (o, max(h, p), min(lo, p), p, v + 1)
    assert got == want


def candle_feed(spark, tmp_path, closes):
    path = str(tmp_path / "candles")
    rows = [("A", START + dt.timedelta(hours=i), float(c)) for i, c in enumerate(closes)]
    half = len(rows) // 2
    schema = "symbol string, ts timestamp_ntz, close double"
    for name, part in (("a", rows[:half]), ("b", rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{name}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    )


def walk(seed, n, scale=0.02):
    rng, out, x = random.Random(seed), [], 100.0
    for _ in range(n):
        x *= 1 + rng.gauss(0, scale)
        out.append(x)
    return out


def keyed(df, label):
    with keyed_state(df.sparkSession):
        return tables.drain_append(df, label)


def zs_of(closes, size):
    zs = [None] * len(closes)
    for i in range(size - 1, len(closes)):
        part = closes[i - size + 1 : i + 1]
        mean = sum(part) / size
        std = (sum((v - mean) ** 2 for v in part) / (size - 1)) ** 0.5
        zs[i] = (closes[i] - mean) / std if std >= 1e-10 else 0.0
    return zs


def test_live_state_over_batches(spark, tmp_path):
    closes = walk(8, 160)
    got = keyed(live.signal_stream(candle_feed(spark, tmp_path, closes)), "signals").orderBy("ts").collect()
    assert len(got) == 160

    fast, slow = loops.ema(closes, 20), loops.ema(closes, 50)
    want = [0] + [
        1 if fast[i - 1] <= slow[i - 1] and fast[i] > slow[i]
        else -1 if fast[i - 1] >= slow[i - 1] and fast[i] < slow[i] else 0
        for i in range(1, 160)
    ]
    assert [r["momentum"] for r in got] == want
    r = loops.rsi(closes, 14)
    # Live RSI acts on the same bar, and stays silent on the bar that seeds its averages.
    want = [0 if v is None or i == 14 else 1 if v < 30 else -1 if v > 70 else 0 for i, v in enumerate(r)]
    assert [g["rsi"] for g in got] == want
    assert [g["mean_reversion"] for g in got] == loops.reversion(zs_of(closes, 20), 19, 2.0)


def in_parts(indicator, closes, cuts):
    """What an indicator says when its closes come in parts."""
    held, earlier, out = None, np.zeros(0), []
    for a, b in zip([0, *cuts], [*cuts, len(closes)]):
        held, earlier, made = indicator.run(held, earlier, np.array(closes[a:b]))
        out += made.tolist()
    return out


def macd_loop(closes, short, long, size):
    fast, slow = sum(closes[long - short : long]) / short, sum(closes[:long]) / long
    signal, hist, want = fast - slow, 0.0, [0] * long
    for c in closes[long:]:
        fast, slow = fast + 2 / (short + 1) * (c - fast), slow + 2 / (long + 1) * (c - slow)
        signal += 2 / (size + 1) * (fast - slow - signal)
        was, hist = hist, fast - slow - signal
        want.append(1 if was < 0 <= hist else -1 if was > 0 >= hist else 0)
    return want


def test_indicators_do_not_see_where_batches_end():
    closes = walk(6, 200)
    z = zs_of(closes, 6)
    cases = [
        (Macd(3, 6, 4), macd_loop(closes, 3, 6, 4)),
        (MeanReversion(6, 1.0, 0.0), loops.reversion(z, 5, 1.0)),
        (MeanReversion(6, 1.0, 1.5), loops.reversion(z, 5, 1.0, 1.5)),
        (MeanReversion(6, 1.0, -1.8), loops.reversion(z, 5, 1.0, -1.8)),
        (Rsi(5, 40, 60), [0 if v is None or i == 5 else 1 if v < 40 else -1 if v > 60 else 0 for i, v in enumerate(loops.rsi(closes, 5))]),
    ]
    for indicator, want in cases:
        assert {1, -1} <= set(want)
        for cuts in ([], [1], [2, 3, 5, 8], [4, 6, 7, 100], list(range(1, 200))):
            assert in_parts(indicator, closes, cuts) == want, indicator
    for cuts in ([], [1], [50, 51], list(range(1, 200))):
        assert np.allclose(in_parts(Average(9), closes, cuts), loops.ema(closes, 9), rtol=1e-12)


def session_feed(spark, path, files):
    """Hourly candles with a watermark, one file per micro-batch; rows inside a file in no order."""
    schema = "symbol string, ts timestamp, close double"
    for n, rows in enumerate(files):
        data = [(s, START + dt.timedelta(hours=h), c) for s, h, c in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{path}/f{n}")
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    return feed.withWatermark("ts", "0 seconds").select(
        "symbol", F.window("ts", "1 hour").alias("window"), "close"
    )


def test_sessions_start_anew_and_leave_no_state(spark, tmp_path):
    files = [
        [("A", 2, 12.0), ("A", 0, 10.0), ("A", 1, 11.0), ("B", 0, 5.0)],
        [("A", 3, 13.0), ("A", 9, 50.0), ("A", 8, 40.0), ("A", 8, 99.0)],
        [("B", 20, 7.0), ("A", 20, 1.0), ("A", 2, 99.0), ("B", 21, 8.0)],
    ]
    feed = session_feed(spark, str(tmp_path / "src"), files)
    got = {}
    for r in keyed(live.session_stream(feed, 3600, span=3), "sessions").collect():
        got[r.symbol, (r.ts - START).total_seconds() // 3600] = (r.close, round(r.ema, 6), (r.session_start - START).total_seconds() // 3600)
    assert got == {
        ("A", 0): (10.0, 10.0, 0), ("A", 1): (11.0, 10.5, 0), ("A", 2): (12.0, 11.25, 0), ("A", 3): (13.0, 12.125, 0),
        ("A", 8): (40.0, 40.0, 8), ("A", 9): (50.0, 45.0, 8), ("A", 20): (1.0, 1.0, 20),
        ("B", 0): (5.0, 5.0, 0), ("B", 20): (7.0, 7.0, 20), ("B", 21): (8.0, 7.5, 20),
    }


class Cell:
    """A value, list or timer store in memory."""

    def __init__(self):
        self.held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


def test_a_timer_clears_the_session():
    timers = []

    class Handle:
        def getValueState(self, name, schema, ttlDurationMs=None):
            return Cell()

        def listTimers(self):
            return list(timers)

        def deleteTimer(self, t):
            timers.remove(t)

        def registerTimer(self, t):
            timers.append(t)

    p = Indicators({"ema": Average(3)}, gap=1_000_000)
    p.init(Handle())
    frame = pd.DataFrame({"ts": np.array([5_000_000, 4_500_000], "datetime64[us]"), "close": [2.0, 1.0]})
    out = pd.concat(p.handleInputRows(("A",), iter([frame]), None))
    assert out["ema"].tolist() == [1.0, 1.5] and timers == [6001]
    assert p.states["ema"].get() == (1.5,)
    assert list(p.handleExpiredTimer(("A",), None, None)) == []
    assert p.states["ema"].get() is None and p.session.get() is None and p.newest.get() == (5_000_000, 0)


def test_alerts_fire_once_on_the_change_of_the_day(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "symbol string, ts timestamp_ntz, open double, close double"
    days = lambda rows: [("A", START + dt.timedelta(hours=h), o, c) for h, o, c in rows]

    def land_candles(name, rows):
        spark.createDataFrame(days(rows), schema).coalesce(1).write.parquet(f"{path}/{name}")

    alerts = spark.createDataFrame(
        [("A", "price_above", 120.0, "n"), ("A", "change_pct_below", -5.0, ""), ("A", "change_pct_above", 50.0, ""), ("A", "bogus", 1.0, ""), ("B", "price_above", 0.0, "")],
        "symbol string, condition string, threshold double, note string",
    )
    feed = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")

    def run():
        with keyed_state(spark):
            tables.finish(tables.start_append(alerting.fired(feed(), alerts), out, state))
        return {(r.condition): ((r.ts - START).total_seconds() // 3600, r.price, round(r.change_pct, 6)) for r in spark.read.parquet(out).collect()}

    # within the hour the price falls by 4 % at most, since the day opened by 6 %
    land_candles("a", [(2, 97.0, 94.0), (1, 98.0, 97.0), (0, 100.0, 98.0)])
    assert run() == {"change_pct_below": (2, 94.0, -6.0)}
    land_candles("b", [(3, 94.0, 121.0), (4, 121.0, 122.0)])
    assert run() == {"change_pct_below": (2, 94.0, -6.0), "price_above": (3, 121.0, 21.0)}
    land_candles("c", [(24, 90.0, 80.0), (25, 80.0, 136.0)])
    assert run()["change_pct_above"] == (25, 136.0, round((136 - 90) / 0.9, 6)) and len(run()) == 3
    assert spark.read.parquet(out).count() == 3


def test_ledger_equity_is_cash_plus_shares(spark, tmp_path):
    rng = random.Random(2)
    closes = [100 + rng.gauss(0, 1) + i * 0.05 for i in range(120)]
    feed = candle_feed(spark, tmp_path, closes)
    params = {"short_window": 3, "long_window": 8}
    rows = keyed(live.ledger_stream(feed, "momentum", params, min_sharpe=-1e9), "ledger").orderBy("ts").collect()
    cash, qty = 100_000.0, 0.0
    for r in rows:
        if r["action"] == "buy":
            assert r["qty"] == int(10_000 / r["price"])
            cash, qty = cash - r["qty"] * r["price"], r["qty"]
        elif r["action"] == "sell":
            cash, qty = cash + r["qty"] * r["price"], 0.0
        assert abs(r["equity"] - (cash + qty * r["price"])) < 1e-6
    assert {"buy", "sell"} <= {r["action"] for r in rows}


def test_ledger_halts_once():
    closes = [100.0, 80.0, 60.0, 50.0, 40.0]
    account, rets, rows = live.trade(live.NEW_ACCOUNT, [], closes[:2], [1, 1], max_drawdown=0.01)
    account, rets, more = live.trade(account, rets, closes[2:], [1, 1, 1], max_drawdown=0.01)
    actions = [r[1] for r in rows + more]
    assert actions[0] == "buy" and actions[-1] == "halt" and actions.count("halt") == 1
    assert live.trade(account, rets, [30.0], [1])[2] == []
