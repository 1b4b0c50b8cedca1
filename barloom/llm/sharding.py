"""Rendezvous sharding over weighted shards, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard that are numbered in one go.
BLOCK_ROWS = 50_000


def unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard alone."""
    top = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return (top.cast("double") + 0.5) / float(1 << 53)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose draw, stretched by its weight, wins: the least -ln(u) / weight.

    A shard gets keys in proportion to its weight. A further shard only takes keys to
    itself, a lost one only gives up its own, and a raised weight only attracts. Equal draws
    go to the smaller shard number; a null key is a key like any other.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    draws = [
        F.struct((-F.log(unit(key, i)) / float(w)).alias("draw"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def numbered(rows: DataFrame, group: str, spread: Sequence[str], name: str = "slot") -> DataFrame:
    """``rows`` with gapless numbers from 0 inside each ``group``.

    A group is cut into blocks by a hash of the ``spread`` columns. Rows are numbered inside
    their block, and a table with one row per block holds the numbers before it. So the
    largest task has one block, not one group. Repeated rows get numbers in any order.
    """
    blocks = max(1, -(-rows.count() // BLOCK_ROWS)) * 4
    cut = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit("block"), *spread), F.lit(blocks)))
    sizes = cut.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("_g"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s")
    )
    inside = Window.partitionBy(group, "_block").orderBy(*spread)
    return (
        cut.withColumn("_i", F.row_number().over(inside) - 1)
        .join(starts, (F.col(group) == F.col("_g")) & (F.col("_block") == F.col("_b")))
        .withColumn(name, (F.col("_s") + F.col("_i")).cast("long"))
        .drop("_block", "_g", "_b", "_s", "_i")
    )


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    ``grown_shard`` is the shard if one more of ``grown_weight`` is added. Only these narrow
    columns are shuffled, texts are not. A null text has size 1 and the checksum of no bytes;
    a null doc_id is one more key. Rows with equal doc_id share a shard, each with a slot of
    its own. An empty table gives an empty result; other columns are left aside.
    """
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"),
    )
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
