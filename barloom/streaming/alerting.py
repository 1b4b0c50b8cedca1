"""Alerts that fire once, over a stream of closed candles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from barloom.operators import alerts as rules
from barloom.streaming.keyed import in_order, keyed_state
from barloom.streaming.tables import drain_append

FIRED = "symbol string, condition string, ts timestamp_ntz, price double, change_pct double, threshold double, note string"
DAY = 86_400_000_000


def day_change(day: np.ndarray, opens: np.ndarray, closes: np.ndarray, held: tuple | None) -> tuple[np.ndarray, float]:
    """Percent change of each close since its day opened, and the open of the last day. ``held``
    is (day, open) of the row before the first one."""
    first = np.concatenate(([True], day[1:] != day[:-1]))
    if held is not None and held[0] == day[0]:
        opens = np.concatenate(([held[1]], opens[1:]))
    since = opens[np.maximum.accumulate(np.where(first, np.arange(len(day)), 0))]
    some = since > 0
    return np.where(some, (closes - since) / np.where(some, since, 1.0) * 100, 0.0), float(since[-1])


class FiredOnce(StatefulProcessor):
    """State per (symbol, condition): the last time, its day, the price at which that day opened,
    and whether the alert has fired, after which nothing is looked at any more."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "at long, day long, open double, fired boolean")

    def handleInputRows(self, key, rows, timerValues):
        held = self.seen.get()
        if held is not None and held[3]:
            return
        at, values, _ = in_order(rows, held[0] if held else -(2**62), ["open", "close", "threshold", "note"])
        if not len(at):
            return
        day, price, threshold = at // DAY, values["close"], values["threshold"]
        change, opened = day_change(day, values["open"], price, held and held[1:3])
        value = price if key[1].startswith("price") else change
        hits = np.flatnonzero(value < threshold if key[1].endswith("below") else value > threshold)
        self.seen.update((int(at[-1]), int(day[-1]), opened, bool(len(hits))))
        if len(hits):
            i = hits[0]
            row = (key[0], key[1], at[i].astype("datetime64[us]"), float(price[i]), float(change[i]), float(threshold[i]), values["note"][i])
            yield pd.DataFrame([row], columns=[c.split()[0] for c in FIRED.split(", ")])

    def close(self) -> None:
        pass


def fired(candles: DataFrame, alerts: DataFrame) -> DataFrame:
    """``candles`` (symbol, ts, open, close) of each day in their order, beside the alerts of their symbol
    ``(symbol, condition, threshold, note)``; every alert comes out once, with its first hit."""
    known = alerts.filter(F.col("condition").isin(rules.CONDITIONS))
    rows = candles.select("symbol", "ts", "open", "close").join(known.select("symbol", "condition", "threshold", "note"), "symbol")
    out = rows.groupBy("symbol", "condition").transformWithStateInPandas(FiredOnce(), FIRED, "Append", "None")
    text = rules.message(*[F.col(c) for c in ("symbol", "condition", "threshold", "note", "price", "change_pct")])
    return out.select("symbol", "condition", "ts", "price", "change_pct", text.alias("message"))


def drain(candles: DataFrame, alerts: DataFrame, label: str = "alerts") -> DataFrame:
    with keyed_state(candles.sparkSession):
        return drain_append(fired(candles, alerts), label)
