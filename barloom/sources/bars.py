"""OHLCV bars: schema, scan and resampling.

A resampled table holds one row per symbol and interval. Its per-symbol length is
therefore bounded by the calendar (a century of daily bars is 36 525 rows, of hourly
bars 876 600) however many ticks a hot symbol contributes, because ticks are combined
map-side before the shuffle.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

REQUIRED = ("open", "high", "low", "close", "volume")

# The candle intervals accepted with each history period, finest first.
LEGAL_INTERVALS = {
    "1d": ["1m", "2m", "5m", "15m", "30m", "60m"],
    "5d": ["1m", "2m", "5m", "15m", "30m", "60m"],
    "1mo": ["5m", "15m", "30m", "60m", "1d"],
    "3mo": ["15m", "30m", "60m", "1d"],
    "6mo": ["1d", "1wk"],
    "1y": ["1d", "1wk"],
    "2y": ["1d", "1wk"],
    "5y": ["1d", "1wk", "1mo"],
}
DEFAULT_PERIOD = "1d"

SECONDS = {"1m": 60, "2m": 120, "5m": 300, "15m": 900, "30m": 1800, "60m": 3600, "1d": 86400}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def balanced(scan: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores.

    Meant for plain scans before heavy per-row work. A large table has more splits than
    cores and is left alone, so this never shuffles it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def scan_bars(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Lower-case the columns, enforce the OHLCV set and keep ``[start, end)``."""
    df = df.toDF(*[c.lower() for c in df.columns])
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing OHLCV columns: {missing}")
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return df


def order_key(*parts: tuple[Column, int]) -> Column:
    """Whole numbers of at least zero, each with its most digits (38 in all), as one number in the
    same order. Folds by a number keep it in a hash table, where a struct would have all rows sorted."""
    out, shift = None, 0
    for part, digits in reversed(parts):
        value = part.cast("decimal(38,0)")
        if shift:
            value = (value * F.lit(Decimal(10) ** shift).cast("decimal(38,0)")).cast("decimal(38,0)")
        out = value if out is None else (out + value).cast("decimal(38,0)")
        shift += digits
    if shift > 38:
        raise ValueError("an order key holds 38 digits")
    return out


def tick_order(ts: str = "ts", seq: str = "seq") -> Column:
    """Time, then sequence number."""
    return order_key((F.unix_micros(F.col(ts).cast("timestamp")), 18), (F.col(seq), 19))


def ohlcv(
    rows: DataFrame, keys: list[str], price: Column, size: Column, order: Column
) -> DataFrame:
    """Fold priced rows into bars; ``order`` must be total inside a bar, and a number lets
    the rows fold without being sorted."""
    rows = rows.select(*keys, price.alias("_p"), size.alias("_q"), order.alias("_o"))
    return rows.groupBy(*keys).agg(
        F.min_by("_p", "_o").alias("open"),
        F.max("_p").alias("high"),
        F.min("_p").alias("low"),
        F.max_by("_p", "_o").alias("close"),
        F.sum("_q").alias("volume"),
    )


def bucket(ts: Column, interval: str) -> Column:
    """Start of the interval that holds ``ts``; weeks start on Monday."""
    if interval == "1wk":
        return F.date_trunc("week", ts).cast("timestamp_ntz")
    if interval == "1mo":
        return F.date_trunc("month", ts).cast("timestamp_ntz")
    seconds = SECONDS[interval]
    epoch = F.unix_timestamp(ts.cast("timestamp"))
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds))).cast("timestamp_ntz")


def resample(ticks: DataFrame, interval: str) -> DataFrame:
    """Ticks ``(symbol, ts, price, size, seq)`` to bars of one interval."""
    keyed = ticks.withColumn("bar_ts", bucket(F.col("ts"), interval))
    bars = ohlcv(
        keyed,
        ["symbol", "bar_ts"],
        F.col("price"),
        F.col("size"),
        tick_order(),
    )
    return bars.withColumnRenamed("bar_ts", "ts")


def resolve_interval(period: str, interval: str) -> str:
    """Requested interval if legal for the period, else the finest legal one."""
    legal = LEGAL_INTERVALS.get(period, LEGAL_INTERVALS[DEFAULT_PERIOD])
    return interval if interval in legal else legal[0]


def candles(ticks: DataFrame, period: str, interval: str, keep: int = 100) -> DataFrame:
    """Chart candles: legal interval, complete prices, 4 decimals, newest ``keep``."""
    bars = resample(ticks, resolve_interval(period, interval)).dropna(
        subset=["open", "high", "low", "close"]
    )
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    bars = bars.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep)
    prices = [F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")]
    return bars.select("symbol", "ts", *prices, "volume")
