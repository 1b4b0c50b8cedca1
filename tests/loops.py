"""Plain loops that the column expressions must agree with."""

import math


def ema(xs, span):
    a, out = 2 / (span + 1), []
    for x in xs:
        out.append(x if not out else a * x + (1 - a) * out[-1])
    return out


def rsi(xs, period):
    out = [None] * len(xs)
    gains = [max(b - a, 0) for a, b in zip(xs, xs[1:])]
    losses = [max(a - b, 0) for a, b in zip(xs, xs[1:])]
    if len(xs) <= period:
        return out
    g, l = sum(gains[:period]) / period, sum(losses[:period]) / period
    for i in range(period, len(xs)):
        out[i] = 100.0 if l == 0 else 100 - 100 / (1 + g / l)
        if i < len(gains):
            g = (g * (period - 1) + gains[i]) / period
            l = (l * (period - 1) + losses[i]) / period
    return out


def reversion(zs, window, t, leave=0.0):
    pos, out = 0, []
    for i, z in enumerate(zs):
        move = 0
        if i >= window and z is not None:
            if pos == 0:
                move = 1 if z < -t else -1 if z > t else 0
            elif pos == 1:
                move = -1 if z >= leave else 0
            else:
                move = 1 if z <= leave else 0
        pos += move
        out.append(move)
    return out


def backtest(opens, closes, signals, p=1.0, c=0.001, long_only=True):
    cash, pos, ep, stake = 100_000.0, 0, 0.0, 0.0
    equity, trades = [], []
    for i, s in enumerate(signals):
        if i + 1 < len(opens):
            x = opens[i + 1]
            if pos == 0 and (s == 1 or (s == -1 and not long_only)):
                pos, ep, stake = s, x, cash * p
            elif pos == 1 and s == -1:
                gain = (1 - c) ** 2 * x / ep - 1
                cash += stake * gain
                trades.append(gain)
                pos = 0
            elif pos == -1 and s == 1:
                gain = (1 - c) * (1 - x / ep) - c - (1 - c) * c * x / ep
                cash += stake * gain
                trades.append(gain)
                pos = 0
        if pos == 1:
            equity.append(cash - stake + stake * (1 - c) * closes[i] / ep)
        elif pos == -1:
            equity.append(cash + stake * ((1 - c) * (1 - closes[i] / ep) - c))
        else:
            equity.append(cash)
    return equity, trades


def close_to(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)
