"""Connected components of a graph of longs by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tables import discard, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: a node hangs its larger neighbours on the least of its neighbours and
    itself. Small star: the same with its smaller neighbours, itself included."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if large:
        pairs = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    met = pairs.join(least, F.col("u") == F.col("w"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("w").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node that can be
    reached. Every round writes its edges to the shared folder; about log n rounds."""
    edges = saved(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while (now := _mark(edges)) != before:
        before, old = now, edges
        edges = saved(_star(_star(edges, large=True), large=False), "edges")
        discard(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
