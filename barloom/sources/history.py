"""Stored analyses: an append-only Parquet table partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns too large for listings, and the largest page.
LARGE = ["equity_curve", "explanation", "raw"]
MAX_PAGE = 100


def save(analyses: DataFrame, path: str) -> None:
    """Append analyses; ``created_at`` gives the day partition."""
    dated = analyses.withColumn("day", F.to_date("created_at"))
    dated.write.mode("append").partitionBy("day").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("day")


def listed(analyses: DataFrame) -> DataFrame:
    return analyses.drop(*[c for c in LARGE if c in analyses.columns])


def newest(analyses: DataFrame, ticker: str | None = None, limit: int = 20) -> DataFrame:
    """One page, newest first. A larger page than 100 rows is refused, not cut."""
    if not 0 < limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} rows, not {limit}")
    d = listed(analyses)
    if ticker is not None:
        d = d.filter(F.col("ticker") == ticker.upper())
    return d.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def recent(analyses: DataFrame, keep: int = 10) -> DataFrame:
    """The newest ``keep`` analyses of every ticker."""
    w = Window.partitionBy("ticker").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return (
        listed(analyses)
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= keep)
        .drop("_n")
    )


def delete(analyses: DataFrame, ids: DataFrame) -> DataFrame:
    return analyses.join(ids, "id", "left_anti")
