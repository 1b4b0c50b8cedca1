"""Chunk table: Parquet partitioned by ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, key: str = "chunk_id", version: str = "version"):
    """Union of both with the latest version per key, folded map-side."""
    both = stored.unionByName(new, allowMissingColumns=True)
    rows = both.groupBy(key).agg(
        F.max_by(F.struct(*[c for c in both.columns if c != key]), version).alias("_r")
    )
    return rows.select(key, "_r.*")


def write(chunks: DataFrame, path: str) -> None:
    """Replace the partitions present in ``chunks`` and leave all others alone."""
    (
        chunks.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ticker")
        .parquet(path)
    )


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def delete_keys(chunks: DataFrame, removals: DataFrame, key: str = "ticker") -> DataFrame:
    """Chunks left after removing whole keys."""
    return chunks.join(removals.select(key).distinct(), key, "left_anti")


def deleted_counts(chunks: DataFrame, removals: DataFrame, key: str = "ticker") -> DataFrame:
    """How many chunks each removal takes away."""
    hits = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("deleted"))
    return hits.join(removals.select(key).distinct(), key)


def existing(ids: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    return ids.join(chunks.select(key), key, "left_semi")


def missing(docs: DataFrame, chunks: DataFrame, first_chunk: Column) -> DataFrame:
    """Documents whose first chunk is not stored yet."""
    stored = chunks.select(F.col("chunk_id").alias("_first"))
    return docs.withColumn("_first", first_chunk).join(stored, "_first", "left_anti").drop("_first")


def stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.countDistinct("parent_doc_id").alias("documents"),
        F.sum(F.length("content")).alias("chars"),
    )
