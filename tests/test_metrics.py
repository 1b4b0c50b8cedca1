import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import metrics as m
from barloom.plans import backtest


def one(spark, values, *aggs):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    return df.agg(*aggs).first()


def test_against_numpy(spark):
    r = np.random.default_rng(7).normal(0, 0.015, 252)
    row = one(
        spark, r, m.sharpe("x"), m.sortino("x"), m.annualized_return("x"),
        m.annualized_volatility("x"), m.historical_var("x"), m.parametric_var("x"),
    )
    down = r[r < 0]
    want = [
        r.mean() / r.std(ddof=1) * np.sqrt(252),
        r.mean() / down.std(ddof=1) * np.sqrt(252),
        (1 + r.mean()) ** 252 - 1,
        r.std(ddof=1) * np.sqrt(252),
        max(-np.percentile(r, 5), 0),
        max(-(r.mean() - 1.6448536269514722 * r.std(ddof=1)), 0),
    ]
    assert np.allclose(list(row), want)


def test_trades(spark):
    row = one(spark, [0.05, -0.02, 0.03, -0.01, 0.04], m.win_rate("x"), m.profit_factor("x"))
    assert row[0] == pytest.approx(0.6)
    assert row[1] == pytest.approx(4.0)
    row = one(spark, [0.1], m.win_rate("x"), m.profit_factor("x"), m.sharpe("x"), m.sortino("x"))
    assert tuple(row) == (1.0, None, 0.0, 0.0)
    row = one(spark, [0.1, 0.2, 0.3], m.sortino("x"))
    assert row[0] is None


def test_flat_and_empty(spark):
    df = spark.createDataFrame([], "x double")
    row = df.agg(m.sharpe("x"), m.win_rate("x"), m.profit_factor("x"), m.annualized_return("x")).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 0.0)
    assert one(spark, [0.01] * 5, m.sharpe("x"))[0] == 0.0
    with pytest.raises(ValueError):
        m.historical_var("x", 1.0)


def test_drawdown_and_report(spark):
    equity = [100, 110, 120, 100, 90, 95, 110, 130]
    df = spark.createDataFrame(
        [("A", i, float(e)) for i, e in enumerate(equity)], "symbol string, idx long, equity double"
    ).withColumn("trade_ret", F.lit(None).cast("double"))
    row = backtest.report(backtest.equity_stats(df), ["symbol"]).first()
    assert row["max_drawdown"] == 0.25
    assert row["total_return"] == 0.3
    assert (row["n_trades"], row["n_days"]) == (0, 7)
    rets = np.diff(equity) / equity[:-1]
    cut = np.percentile(rets, 5)
    assert row["cvar_95"] == pytest.approx(-rets[rets <= cut].mean(), abs=1e-6)
