"""Trading signals: 1 buy, 0 hold, -1 sell. Input is indexed bars per series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from barloom.operators import recurrence, rolling
from barloom.operators.series import BY_SYMBOL, INDEX, Layout, over_lookback

BUY, HOLD, SELL = 1, 0, -1
#: Bars that are composed in one go.
EXIT_BLOCK_ROWS = 65_536

# Default parameters of each strategy.
DEFAULTS = {
    "momentum": {"short_window": 20, "long_window": 50},
    "mean_reversion": {"window": 20, "z_threshold": 2.0, "exit_threshold": 0.0},
    "rsi": {"period": 14, "oversold": 30.0, "overbought": 70.0},
    "macd": {"fast": 12, "slow": 26, "signal_period": 9},
}


def signal_of(buy: Column, sell: Column) -> Column:
    return F.when(buy, BUY).when(sell, SELL).otherwise(HOLD).cast("int")


def crossover(df: DataFrame, fast: str, slow: str, first: int, layout: Layout = BY_SYMBOL):
    """Signal where ``fast`` crosses ``slow``, from index ``first`` on."""

    def build(d: DataFrame, w) -> DataFrame:
        was, base = F.lag(fast).over(w), F.lag(slow).over(w)
        live = F.col(INDEX) >= first
        return d.withColumn(
            "signal",
            signal_of(
                live & (was <= base) & (F.col(fast) > F.col(slow)),
                live & (was >= base) & (F.col(fast) < F.col(slow)),
            ),
        )

    return over_lookback(df, layout, 1, build)


def momentum(
    df: DataFrame, short_window=20, long_window=50, use_ema=False, layout: Layout = BY_SYMBOL
) -> DataFrame:
    """Crossover of two moving averages."""
    sizes = {"ma_short": int(short_window), "ma_long": int(long_window)}
    out = (
        recurrence.ema(df, sizes, layout=layout)
        if use_ema
        else rolling.rolling_means(df, sizes, layout=layout)
    )
    return crossover(out, "ma_short", "ma_long", int(long_window), layout)


def mean_reversion(
    df: DataFrame, window=20, z_threshold=2.0, exit_threshold=0.0, layout: Layout = BY_SYMBOL
) -> DataFrame:
    """Enter beyond the threshold, leave when the z-score is back at ``exit_threshold``."""
    out = rolling.zscore(df, int(window), layout=layout)
    return reversion_signals(out, int(window), z_threshold, exit_threshold, layout)


def composed(maps: np.ndarray) -> np.ndarray:
    """Prefix compositions of transition maps: row i tells where rows 0 to i lead from each
    state. Doubling, as composition is associative."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        earlier = out[:-reach].copy()
        out[reach:] = np.take_along_axis(out[reach:], earlier, axis=1)
        reach *= 2
    return out


def reversion_maps(z: np.ndarray, enter, leave: float) -> np.ndarray:
    """For each z, the state (0 short, 1 flat, 2 long) that follows each state; NaN changes none."""
    maps = np.tile(np.arange(3), (len(z), 1))
    maps[z <= leave, 0] = 1
    maps[z < -enter, 1] = 2
    maps[z > enter, 1] = 0
    maps[z >= leave, 2] = 1
    return maps


def reversion_signals(
    df: DataFrame, window, z_threshold, exit_threshold: float, layout: Layout
) -> DataFrame:
    """Position automaton over a ``z`` column, as window functions.

    This holds for an exit level inside the entry levels; any other goes to ``_any_exit``.
    Cut the bars into runs on one side of the exit level. A position opened in a run
    stays open to its end and closes on the first bar of the next run, which that close
    uses up. So a run ends in a position if a bar after its first crosses the threshold,
    or if only its first bar does and the run before ended flat. Runs of the last kind
    toggle the state; all others settle it, and the state follows from the last settled
    run and the number of toggles since.
    """
    limit = z_threshold if isinstance(z_threshold, Column) else F.lit(float(z_threshold))
    if exit_threshold and (isinstance(z_threshold, Column) or abs(exit_threshold) > z_threshold):
        return _any_exit(df, window, limit, float(exit_threshold), layout)
    w = Window.partitionBy(*layout.keys).orderBy(INDEX)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    z = F.when(F.col(INDEX) >= window, F.col("z"))
    d = df.withColumns(
        {
            "_side": F.signum(z - exit_threshold),
            "_hit": F.coalesce((z < -limit) | (z > limit), F.lit(False)),
        }
    )
    d = d.withColumn("_was", F.last("_side", ignorenulls=True).over(before))
    d = d.withColumn(
        "_new",
        F.col("_side").isNotNull() & (F.col("_was").isNull() | (F.col("_was") != F.col("_side"))),
    )
    d = d.withColumns(
        {
            "_start": F.max(F.when(F.col("_new"), F.col(INDEX))).over(upto),
            "_first_hit": F.last(F.when(F.col("_new"), F.col("_hit")), ignorenulls=True).over(upto),
            "_late": F.max(F.when(F.col("_hit") & ~F.col("_new"), F.col(INDEX))).over(upto),
            "_late_before": F.max(F.when(F.col("_hit") & ~F.col("_new"), F.col(INDEX))).over(before),
        }
    )
    # Class of the run before, known on the first bar of a run: 1 and 0 settle, 2 toggles.
    d = d.withColumns(
        {"_p_start": F.lag("_start").over(w), "_p_first": F.lag("_first_hit").over(w),
         "_p_late": F.lag("_late").over(w)}
    )
    kind = (
        F.when(F.col("_p_late") >= F.col("_p_start"), 1)
        .when(F.col("_p_first"), 2)
        .otherwise(0)
    )
    d = d.withColumn("_kind", F.when(F.col("_new") & F.col("_p_start").isNotNull(), kind))
    d = d.withColumn("_toggles", F.sum(F.when(F.col("_kind") == 2, 1).otherwise(0)).over(upto))
    settled = F.when(
        F.col("_kind").isin(0, 1), F.struct(F.col("_kind").alias("k"), F.col("_toggles").alias("t"))
    )
    d = d.withColumn("_settled", F.last(settled, ignorenulls=True).over(upto))
    carried = (
        F.coalesce(F.col("_settled.k"), F.lit(0))
        + F.col("_toggles")
        - F.coalesce(F.col("_settled.t"), F.lit(0))
    ) % 2
    d = d.withColumn("_open", F.last(F.when(F.col("_new"), carried), ignorenulls=True).over(upto))
    first_taken = F.col("_first_hit") & (F.col("_open") == 0)
    opens = F.col("_hit") & F.when(F.col("_new"), F.col("_open") == 0).otherwise(
        ~first_taken & (F.col("_late_before").isNull() | (F.col("_late_before") < F.col("_start")))
    )
    closes = F.col("_new") & (F.col("_open") == 1)
    signal = F.when(closes, F.col("_was")).when(opens, -F.col("_side")).otherwise(0).cast("int")
    return d.withColumn("signal", signal).drop(
        "_side", "_hit", "_was", "_new", "_start", "_first_hit", "_late", "_late_before",
        "_p_start", "_p_first", "_p_late", "_kind", "_toggles", "_settled", "_open",
    )


def _any_exit(df: DataFrame, window: int, limit: Column, leave: float, layout: Layout) -> DataFrame:
    """The automaton for any exit level. A bar maps the three positions to three positions, and
    the positions after each bar are the prefix compositions of these maps. Composition is associative, so
    bars are composed in blocks, blocks are composed in their order, and every block then
    starts where the one before has ended."""
    rows = layout.rows or EXIT_BLOCK_ROWS
    keys = [*layout.keys, "_cut"]

    def frames(batch: pa.Table):
        z = batch.column("_z").to_numpy(zero_copy_only=False).astype(float)
        order = np.argsort(batch.column(INDEX).to_numpy(zero_copy_only=False), kind="stable")
        enter = batch.column("_limit").to_numpy(zero_copy_only=False)[order]
        return order, composed(reversion_maps(z[order], enter, leave))

    def summary(batch: pa.Table) -> pa.Table:
        _, maps = frames(batch)
        own = {k: [batch.column(k)[0].as_py()] for k in keys}
        return pa.table(own | {"_to": [maps[-1].tolist()]}, schema=ends)

    def steps(batch: pa.Table, from_: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return batch.drop_columns(["_z", "_limit"]).append_column("signal", pa.array([], pa.int32()))
        order, maps = frames(batch)
        start = from_.column("_from")[0].as_py() if from_.num_rows else 1
        after = maps[:, start] - 1
        moves = np.empty(len(order), np.int32)
        moves[order] = after - np.concatenate(([start - 1], after[:-1]))
        return batch.drop_columns(["_z", "_limit"]).append_column("signal", pa.array(moves, pa.int32()))

    d = df.withColumns({"_cut": F.floor(F.col(INDEX) / rows), "_z": F.when(F.col(INDEX) >= window, F.col("z")).cast("double"), "_limit": limit})
    fields = [df.schema[k] for k in layout.keys]
    ends = to_arrow_schema(StructType([*fields, StructField("_cut", LongType()), StructField("_to", ArrayType(IntegerType()))]))
    of_keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    ending = d.select(*keys, INDEX, "_z", "_limit").groupBy(*keys).applyInArrow(summary, f"{of_keys}, _cut long, _to array<int>")
    before = Window.partitionBy(*layout.keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    chained = F.aggregate(F.collect_list("_to").over(before), F.lit(1), lambda at, to: F.get(to, at))
    starts = ending.select(*keys, chained.alias("_from"))
    out = StructType([*d.drop("_z", "_limit").schema.fields, StructField("signal", IntegerType())])
    return d.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInArrow(steps, out).drop("_cut")


def rsi_levels(
    df: DataFrame, period=14, oversold=30.0, overbought=70.0, layout: Layout = BY_SYMBOL
) -> DataFrame:
    """Buy below ``oversold``, sell above ``overbought``, acting one bar later."""
    out = recurrence.rsi(df, int(period), layout=layout)

    def build(d: DataFrame, w) -> DataFrame:
        prev = F.lag("rsi").over(w)
        return d.withColumn("signal", signal_of(prev < oversold, prev > overbought))

    return over_lookback(out, layout, 1, build)


def macd_cross(
    df: DataFrame, fast=12, slow=26, signal_period=9, layout: Layout = BY_SYMBOL
) -> DataFrame:
    """Sign change of the MACD histogram, acting one bar later."""
    out = recurrence.macd(df, int(fast), int(slow), int(signal_period), layout=layout)
    return histogram_signals(out, int(slow) + int(signal_period), layout)


def histogram_signals(df: DataFrame, first: int, layout: Layout) -> DataFrame:
    def build(d: DataFrame, w) -> DataFrame:
        now, was = F.lag("hist", 1).over(w), F.lag("hist", 2).over(w)
        live = F.col(INDEX) >= first
        return d.withColumn(
            "signal", signal_of(live & (was < 0) & (now >= 0), live & (was > 0) & (now <= 0))
        )

    return over_lookback(df, layout, 2, build)


GENERATORS = {
    "momentum": momentum,
    "mean_reversion": mean_reversion,
    "rsi": rsi_levels,
    "macd": macd_cross,
}


def generate(df: DataFrame, strategy: str, params: dict | None = None, layout: Layout = BY_SYMBOL):
    """Signals of a named strategy with its defaults overridden by ``params``."""
    return GENERATORS[strategy](df, **(DEFAULTS[strategy] | (params or {})), layout=layout)


def strategy_name(strategy: str, params: dict) -> str:
    p = DEFAULTS[strategy] | params
    if strategy == "momentum":
        kind = "EMA" if p.get("use_ema") else "SMA"
        return f"Momentum_{kind}_{p['short_window']}_{p['long_window']}"
    if strategy == "mean_reversion":
        return f"MeanReversion_W{p['window']}_Z{p['z_threshold']}"
    if strategy == "rsi":
        return f"RSI_P{p['period']}_OS{int(p['oversold'])}_OB{int(p['overbought'])}"
    return f"MACD_{p['fast']}_{p['slow']}_{p['signal_period']}"


def positions(
    df: DataFrame, long_only: bool = True, layout: Layout = BY_SYMBOL, fill: str | None = None
) -> DataFrame:
    """Position after each bar's signal. The last bar cannot trade.

    Long only: the side of the last signal, floored at flat. Long/short: each signal moves
    one step between -1 and 1. Two equal signals in a row pin the position to their side;
    in between, signals alternate and so does the position between that side and flat.
    """
    w = Window.partitionBy(*layout.keys).orderBy(INDEX)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    price = F.lead("open").over(w) if fill is None else F.col(fill)
    usable = F.when(price.isNotNull(), F.nullif(F.col("signal"), F.lit(0)))
    d = df.withColumn("_act", usable)
    if long_only:
        held = F.coalesce(F.last("_act", ignorenulls=True).over(upto), F.lit(0))
        return d.withColumn("pos", F.when(held == 1, 1).otherwise(0)).drop("_act")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns(
        {
            "_prev": F.last("_act", ignorenulls=True).over(before),
            "_count": F.count("_act").over(upto),
        }
    )
    pins = F.col("_act").isNotNull() & (F.col("_prev").isNull() | (F.col("_prev") == F.col("_act")))
    pin = F.when(pins, F.struct(F.col("_act").alias("side"), F.col("_count").alias("n")))
    d = d.withColumn("_pin", F.last(pin, ignorenulls=True).over(upto))
    away = (F.col("_count") - F.col("_pin.n")) % 2
    pos = F.coalesce(F.when(away == 0, F.col("_pin.side")).otherwise(0), F.lit(0)).cast("int")
    return d.withColumn("pos", F.when(F.col("_pin").isNull(), 0).otherwise(pos)).drop(
        "_act", "_prev", "_count", "_pin"
    )
