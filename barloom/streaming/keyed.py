"""Indicators with typed state per key, stepped forward by whole micro-batches.

A processor holds a few numbers per symbol in value states and at most one window of closes
in a list state. The closes of a micro-batch are put in time order as plain arrays and every
indicator advances over all of them at once: exponential averages in one weighted
pass, windows as views, the reversion automaton as a scan of transition maps.

Closed candles leave the windowed aggregation in the order of their time, batch after batch; a
row that is not newer than the last one processed is left out and counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from barloom.operators.signals import BUY, HOLD, SELL, composed, reversion_maps
from barloom.session import ROCKSDB_PROVIDER

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
TINY = 1e-10
#: Window rows that are looked at in one go.
VIEW_ROWS = 65_536


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started in here keep their state in the store that keyed processors need.
    A query takes its settings along when it starts, so others are not changed."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB_PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def smoothed(values: np.ndarray, alpha: float, start: float | None) -> np.ndarray:
    """Exponential average of ``values`` that goes on from ``start``, or from the first value."""
    if not len(values):
        return values
    seeded = values if start is None else np.concatenate(([start], values))
    out = pd.Series(seeded).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return out if start is None else out[1:]


def before(values: np.ndarray, first: float) -> np.ndarray:
    return np.concatenate(([first], values[:-1]))


def crossings(was_over: np.ndarray, was_under: np.ndarray, over: np.ndarray, under: np.ndarray) -> np.ndarray:
    return np.where(was_under & over, BUY, np.where(was_over & under, SELL, HOLD))


def zscores(earlier: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """z of each value in the window that it ends, NaN until that is full, 0 where it is flat."""
    seen = np.concatenate((earlier, values))
    out = np.full(len(values), np.nan)
    ends = np.arange(max(size - 1, len(earlier)), len(seen))
    for part in np.array_split(ends, max(1, -(-len(ends) // VIEW_ROWS))):
        if not len(part):
            continue
        view = np.lib.stride_tricks.sliding_window_view(seen[part[0] - size + 1 : part[-1] + 1], size)
        mean, std = view.mean(axis=1), view.std(axis=1, ddof=1)
        flat = std < TINY
        out[part - len(earlier)] = np.where(flat, 0.0, (seen[part] - mean) / np.where(flat, 1.0, std))
    return out


@dataclass(frozen=True)
class Average:
    """Exponential average, seeded by the first close."""

    span: int = 20
    state, window, kind = "value double", 0, "double"

    def run(self, held, earlier, closes):
        out = smoothed(closes, 2 / (self.span + 1), held and held[0])
        return (float(out[-1]),), earlier, out


@dataclass(frozen=True)
class Momentum:
    """Crossing of two exponential averages."""

    short_window: int = 20
    long_window: int = 50
    state, window, kind = "fast double, slow double", 0, "int"

    def run(self, held, earlier, closes):
        fast0, slow0 = held or (None, None)
        fast = smoothed(closes, 2 / (self.short_window + 1), fast0)
        slow = smoothed(closes, 2 / (self.long_window + 1), slow0)
        gap = fast - slow
        was = before(gap, np.nan if held is None else fast0 - slow0)
        return (float(fast[-1]), float(slow[-1])), earlier, crossings(was >= 0, was <= 0, gap > 0, gap < 0)


@dataclass(frozen=True)
class MeanReversion:
    """Enter beyond the threshold, leave at the exit level, whatever that is."""

    window: int = 20
    z_threshold: float = 2.0
    exit_threshold: float = 0.0
    state, kind = "held int", "int"

    def run(self, held, earlier, closes):
        z = zscores(earlier, closes, self.window)
        start = 0 if held is None else held[0]
        after = composed(reversion_maps(z, self.z_threshold, self.exit_threshold))[:, start + 1] - 1
        moves = after - before(after, start)
        return (int(after[-1]),), np.concatenate((earlier, closes))[-self.window :], moves


@dataclass(frozen=True)
class Rsi:
    """Wilder's index against two levels; silent until the averages have had a change after their seed."""

    period: int = 14
    oversold: float = 30.0
    overbought: float = 70.0
    state, window, kind = "close double, changes long, up double, down double", 0, "int"

    def run(self, held, earlier, closes):
        last, n, up, down = held or (None, 0, 0.0, 0.0)
        change = np.diff(closes if last is None else np.concatenate(([last], closes)))
        out = np.zeros(len(closes), int)
        seed = min(max(self.period - n, 0), len(change))
        up += np.maximum(change[:seed], 0).sum() / self.period
        down += np.maximum(-change[:seed], 0).sum() / self.period
        later = change[seed:]
        if len(later):
            ups = smoothed(np.maximum(later, 0), 1 / self.period, up)
            downs = smoothed(np.maximum(-later, 0), 1 / self.period, down)
            value = np.where(downs == 0, 100.0, 100 - 100 / (1 + ups / np.where(downs == 0, 1.0, downs)))
            out[-len(later) :] = np.where(value < self.oversold, BUY, np.where(value > self.overbought, SELL, HOLD))
            up, down = ups[-1], downs[-1]
        return (float(closes[-1]), n + len(change), float(up), float(down)), earlier, out


@dataclass(frozen=True)
class Macd:
    """Sign change of the histogram. The averages start as means of the first ``slow`` closes
    and of the last ``fast`` of these."""

    fast: int = 12
    slow: int = 26
    signal_period: int = 9
    state, kind = "closes long, fast double, slow double, signal double, hist double", "int"

    @property
    def window(self) -> int:
        return self.slow

    def run(self, held, earlier, closes):
        n, fast, slow, signal, hist = held or (0, None, None, None, None)
        warm = min(max(self.slow - n, 0), len(closes))
        out = np.zeros(len(closes), int)
        if warm:
            earlier = np.concatenate((earlier, closes[:warm]))
            if len(earlier) == self.slow:
                fast, slow, hist = earlier[-self.fast :].mean(), earlier.mean(), 0.0
                signal, earlier = fast - slow, earlier[:0]
        later = closes[warm:]
        if len(later):
            quick, calm = smoothed(later, 2 / (self.fast + 1), fast), smoothed(later, 2 / (self.slow + 1), slow)
            line = smoothed(quick - calm, 2 / (self.signal_period + 1), signal)
            gap = quick - calm - line
            was = before(gap, hist)
            out[warm:] = crossings(was > 0, was < 0, gap >= 0, gap <= 0)
            fast, slow, signal, hist = quick[-1], calm[-1], line[-1], gap[-1]
        number = lambda v: None if v is None else float(v)
        return (n + len(closes), *map(number, (fast, slow, signal, hist))), earlier, out


STRATEGIES = {"momentum": Momentum, "mean_reversion": MeanReversion, "rsi": Rsi, "macd": Macd}


def in_order(rows: Iterator[pd.DataFrame], newest: int, columns: list[str]) -> tuple[np.ndarray, dict, int]:
    """Times in microseconds, columns in their order and the number of rows left out, which are
    not newer than ``newest`` or repeat a time. 8 bytes per value: the hourly candles of
    a century, should one batch bring them all, are 14 MB."""
    parts = [(p["ts"].to_numpy("datetime64[us]").astype("int64"), [p[c].to_numpy() for c in columns]) for p in rows]
    at = np.concatenate([a for a, _ in parts])
    order = np.unique(at, return_index=True)[1]
    order = order[at[order] > newest]
    values = {c: np.concatenate([v[i] for _, v in parts])[order] for i, c in enumerate(columns)}
    return at[order], values, len(at) - len(order)


class Indicators(StatefulProcessor):
    """Any number of indicators over the closes of a key.

    With ``gap`` (microseconds) a longer pause ends a session: the next row starts with
    empty state, and a timer of event time clears what the last session left once the watermark
    has passed its end.
    """

    def __init__(self, indicators: dict, gap: int | None = None):
        self.indicators, self.gap = indicators, gap

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long, late long")
        self.session = handle.getValueState("session", "start long")
        self.states = {n: handle.getValueState(n, i.state) for n, i in self.indicators.items()}
        self.windows = {n: handle.getListState(f"{n}_window", "close double") for n, i in self.indicators.items() if i.window}

    def forget(self) -> None:
        for state in (self.session, *self.states.values(), *self.windows.values()):
            state.clear()

    def handleInputRows(self, key, rows, timerValues):
        newest, late = self.newest.get() or (-(2**62), 0)
        at, values, left_out = in_order(rows, newest, ["close"])
        if not len(at):
            self.newest.update((newest, late + left_out))
            return
        starts = np.flatnonzero(np.diff(at) > self.gap) + 1 if self.gap is not None else np.zeros(0, int)
        session = self.session.get()
        if session is None or (self.gap is not None and at[0] - newest > self.gap):
            held, windows, begun = dict.fromkeys(self.indicators), {}, int(at[0])
        else:
            held = {n: s.get() for n, s in self.states.items()}
            windows = {n: np.array([r[0] for r in w.get()], float) for n, w in self.windows.items()}
            begun = session[0]
        none, made, since = np.zeros(0), {n: [] for n in self.indicators}, []
        for first, stop in zip([0, *starts], [*starts, len(at)]):
            if first:
                held, windows, begun = dict.fromkeys(self.indicators), {}, int(at[first])
            since.append(np.full(stop - first, begun))
            for name, indicator in self.indicators.items():
                held[name], windows[name], out = indicator.run(held[name], windows.get(name, none), values["close"][first:stop])
                made[name].append(out)
        self.newest.update((int(at[-1]), late + left_out))
        self.session.update((begun,))
        for name, state in self.states.items():
            state.update(held[name])
        for name, window in self.windows.items():
            if len(windows[name]):
                window.put([(float(v),) for v in windows[name]])
            else:
                window.clear()
        if self.gap is not None:
            self.wake((int(at[-1]) + self.gap) // 1000 + 1)
        out = {"symbol": key[0], "ts": at.astype("datetime64[us]"), "close": values["close"]}
        if self.gap is not None:
            out["session_start"] = np.concatenate(since).astype("datetime64[us]")
        yield pd.DataFrame(out | {n: np.concatenate(m) for n, m in made.items()})

    def wake(self, millis: int) -> None:
        """One timer per key: the end of the session that is open."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(millis)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


def follow(candles: DataFrame, indicators: dict, gap_seconds: float | None = None) -> DataFrame:
    """One row per closed candle ``(symbol, ts, close)`` and a column per indicator.

    With ``gap_seconds`` indicators start anew with every session, whose start is given too; then
    ``candles`` must carry a watermark.
    """
    gap = None if gap_seconds is None else int(gap_seconds * 1_000_000)
    start = "" if gap is None else "session_start timestamp_ntz, "
    columns = ", ".join(f"{n} {i.kind}" for n, i in indicators.items())
    return candles.groupBy("symbol").transformWithStateInPandas(
        Indicators(indicators, gap),
        f"symbol string, ts timestamp_ntz, close double, {start}{columns}",
        "Append",
        "None" if gap is None else "EventTime",
    )
