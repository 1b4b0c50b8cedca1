"""Live averages, signals and the paper ledger over a stream of closed candles.

Candles come from the windowed aggregation, so a processor sees at most one row per interval
however many ticks a symbol has.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.signals import BUY, DEFAULTS, SELL
from barloom.streaming.keyed import STRATEGIES, TINY, Average, Indicators, Momentum, follow

# Sizing and risk limits of the paper ledger.
TRADE_USD, POSITION_USD, START_CAPITAL = 10_000.0, 50_000.0, 100_000.0
MAX_DRAWDOWN, MIN_SHARPE, SHARPE_WINDOW = 0.10, 0.0, 60


def strategy(name: str, params: dict | None = None):
    return STRATEGIES[name](**(DEFAULTS[name] | (params or {})))


def ema_stream(candles: DataFrame, span: int) -> DataFrame:
    return follow(candles.select("symbol", "ts", "close"), {"ema": Average(span)})


def signal_stream(candles: DataFrame, strategies: dict[str, dict] | None = None) -> DataFrame:
    """One signal column per strategy and candle."""
    chosen = strategies or dict.fromkeys(STRATEGIES)
    return follow(candles.select("symbol", "ts", "close"), {n: strategy(n, p) for n, p in chosen.items()}).drop("close")


def session_stream(candles: DataFrame, gap_seconds: float, span: int = 5, short_window: int = 3, long_window: int = 8) -> DataFrame:
    """An average and crossing signals that start anew with every session of a symbol: with
    the first candle that begins more than ``gap_seconds`` after the one before."""
    rows = candles.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("ts"), "close", F.window_time("window").alias("closed_at"))
    return follow(rows, {"ema": Average(span), "signal": Momentum(short_window, long_window)}, gap_seconds)


LEDGER = (
    "signal int, action string, qty double, price double, position double, equity double, "
    "drawdown double, sharpe double"
)
ACCOUNT = "cash double, qty double, equity double, peak double, drawdown double, sharpe double, halted boolean"
NEW_ACCOUNT = (START_CAPITAL, 0.0, START_CAPITAL, 0.0, 0.0, None, False)


def trade(account: tuple, rets: list[float], closes, signals, size=1.0, max_drawdown=MAX_DRAWDOWN, min_sharpe=MIN_SHARPE):
    """(account, returns, rows): whole shares are traded on signals; the account stops for good once
    the metrics of the bar before break a limit. Equity is cash plus shares at the close."""
    cash, held, equity, peak, drawdown, sharpe, halted = account
    rows, rets = [], list(rets)
    for price, signal in zip(map(float, closes), map(int, signals)):
        if halted:
            break
        action, qty = "hold", 0.0
        halted = drawdown > max_drawdown or (sharpe is not None and sharpe < min_sharpe)
        if halted:
            action = "halt"
        elif signal == BUY and held == 0:
            qty = float(int(min(TRADE_USD, POSITION_USD, equity * size) / price))
            action = "buy" if qty > 0 else "hold"
            cash, held = cash - qty * price, qty
        elif signal == SELL and held > 0:
            action, qty, cash, held = "sell", held, cash + held * price, 0.0
        if not halted:
            was, equity = equity, cash + held * price
            peak = max(peak, equity)
            drawdown = (peak - equity) / peak if peak > 0 else 0.0
            rets = (rets + [(equity - was) / was if was > 0 else 0.0])[-SHARPE_WINDOW:]
            std = float(np.std(rets, ddof=1)) if len(rets) == SHARPE_WINDOW else 0.0
            sharpe = float(np.mean(rets)) / std * math.sqrt(252) if std >= TINY else None
        rows.append((signal, action, qty, price, held, equity, drawdown, sharpe))
    return (cash, held, equity, peak, drawdown, sharpe, bool(halted)), rets, rows


class Ledger(Indicators):
    """Accounts that trade on the signals of one indicator."""

    def __init__(self, indicator, limits: dict):
        super().__init__({"signal": indicator})
        self.limits = limits

    def init(self, handle) -> None:
        super().init(handle)
        self.account = handle.getValueState("account", ACCOUNT)
        self.returns = handle.getListState("returns", "ret double")

    def handleInputRows(self, key, rows, timerValues):
        account = self.account.get() or NEW_ACCOUNT
        if account[-1]:
            return
        for candles in super().handleInputRows(key, rows, timerValues):
            rets = [r[0] for r in self.returns.get()]
            account, rets, made = trade(account, rets, candles["close"], candles["signal"], **self.limits)
            self.account.update(account)
            if rets:
                self.returns.put([(r,) for r in rets])
            names = [c.split()[0] for c in LEDGER.split(", ")]
            table = pd.DataFrame(made, columns=names)
            table.insert(0, "symbol", key[0])
            table.insert(1, "ts", candles["ts"].to_numpy()[: len(made)])
            yield table


def ledger_stream(candles: DataFrame, name: str = "momentum", params: dict | None = None, **limits) -> DataFrame:
    return candles.select("symbol", "ts", "close").groupBy("symbol").transformWithStateInPandas(
        Ledger(strategy(name, params), limits), f"symbol string, ts timestamp_ntz, {LEDGER}", "Append", "None"
    )


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Performance of a live run per symbol, from its ledger table."""
    last = lambda c: F.max_by(c, "ts")
    return ledger.groupBy("symbol").agg(
        F.round(last("equity") / START_CAPITAL - 1, 6).alias("total_return"),
        F.round(last("drawdown"), 6).alias("current_drawdown"),
        F.round(F.coalesce(last("sharpe"), F.lit(0.0)), 4).alias("current_sharpe"),
        F.round(F.max("equity"), 2).alias("peak_equity"),
        F.round(last("equity"), 2).alias("current_equity"),
        F.count_if(F.col("action").isin("buy", "sell")).alias("n_trades"),
        F.count(F.lit(1)).alias("bars_processed"),
        last("position").alias("current_position"),
        F.max(F.col("action") == "halt").alias("halted"),
    )
