"""Exact duplicates through an extendible-hash index on shared files, DataFrames only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.tables import Members, discard, saved, text_key, without

#: Different texts that a bucket of the index may hold before it splits.
BUCKET_TEXTS = 4096
#: Leading bits of the hash that a directory can tell apart.
MOST_BITS = 60


def squeezed(text: Column) -> Column:
    """``text`` without space and U+0009 to U+000D; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def key_hash(norm: Column) -> Column:
    return F.xxhash64(norm)


def digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def directory(entries: DataFrame, capacity: int) -> tuple[int, DataFrame]:
    """Global depth and the table (slot, bucket, depth) of an index over ``entries.h``, written.

    The directory has 2**depth slots, the leading bits of the hash. It doubles until no
    bucket holds more than ``capacity`` entries, unless they all have one hash; slots of a bucket that
    never split share it. A histogram of fine slots stands for the entries, so every doubling is
    a sum over it; where a fine slot is still overfull, the histogram is made finer.
    """
    fine = max(4, (entries.count() // capacity).bit_length() + 6)
    while True:
        at = F.shiftrightunsigned("h", 64 - fine).cast("long").alias("fine")
        slots = saved(entries.groupBy(at).agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")), "exact-slots")
        if fine >= MOST_BITS or slots.where((F.col("n") > capacity) & (F.col("lo") < F.col("hi"))).isEmpty():
            break
        discard(slots)
        fine = min(MOST_BITS, fine + 8)
    levels = slots.select("fine", "n", F.explode(F.sequence(F.lit(0), F.lit(fine))).alias("depth")).select(
        "fine", "n", "depth", F.expr(f"shiftright(fine, {fine} - depth)").alias("prefix")
    )
    fits = (
        levels.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
        .where((F.col("held") <= capacity) | (F.col("depth") == fine))
    )
    # the shallowest bucket that fits, for every fine slot
    leaf = (
        levels.join(fits, ["depth", "prefix"]).groupBy("fine").agg(F.min("depth").alias("depth"))
        .withColumn("bucket", F.expr(f"shiftleft(shiftright(fine, {fine} - depth), {fine} - depth)"))
    )
    leaf = saved(leaf, "exact-leaves")
    depth = leaf.agg(F.max("depth")).first()[0] or 0
    cut = F.expr(f"shiftright(fine, {fine - depth})")
    table = saved(leaf.groupBy(cut.alias("slot")).agg(F.min("bucket").alias("bucket"), F.min("depth").alias("depth")), "exact-directory")
    discard(slots)
    discard(leaf)
    return depth, table


def build(docs: DataFrame, capacity: int = BUCKET_TEXTS, hashed=key_hash, digested=digest) -> tuple[DataFrame, DataFrame]:
    """(rows, index), both written to the shared folder.

    rows: doc_id, code_points, h, digest and text key of every document. index: one entry per different
    text, made by the task that owns its bucket: bucket, h, digest, n (rows), best (of the row that
    stays), chain (place among different texts with the same hash), in key order.

    Copies fold before anything moves, by the bytes themselves wherever a hash occurs more than once; hashes
    that occur once need no comparison, and a filter of fixed size keeps their texts where they are. What is left
    probes the directory: its slot names the bucket, probes are dealt by the bucket alone, and the
    owner chains equal hashes and compares the bytes along each chain. Two texts that agree in hash and
    digest but not in bytes would fail the job, not merge.
    """
    norm = squeezed(F.col("text"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = saved(
        base.select(
            "doc_id",
            F.coalesce(F.length("text"), F.lit(0)).alias("code_points"),
            hashed(norm).alias("h"),
            digested(norm).alias("digest"),
            text_key().alias("key"),
        ),
        "exact-rows",
    )
    # among equals the most code points stay, then the smallest id; no id comes last
    best = F.struct(F.col("code_points"), F.col("doc_id").isNotNull().alias("has"), F.bitwise_not("doc_id").alias("minus"))
    entries = saved(
        rows.groupBy("h", "digest").agg(F.count("*").alias("n"), F.max(best).alias("best")), "exact-entries"
    )
    often = entries.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    members = Members(often, F.xxhash64("h"))
    texts = base.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("code_points"), hashed(norm).alias("h"), digested(norm).alias("digest"), norm.alias("norm"))
    compared = (
        members.mark(texts, F.xxhash64("h"), "_maybe").where("_maybe")
        .groupBy("h", "digest", "norm").agg(F.count("*").alias("n"), F.max(best).alias("best"))
    )
    once = members.mark(entries, F.xxhash64("h"), "_maybe").where("not _maybe")
    probes = compared.select("h", "digest", "n", "best", "norm").union(once.select("h", "digest", "n", "best", F.lit(None).cast("string")))
    depth, slots = directory(entries, capacity)
    index = saved(_chained(probes, depth, slots), "exact-index")
    for spent in (entries, slots):
        discard(spent)
    return rows, index


def _chained(probes: DataFrame, depth: int, slots: DataFrame) -> DataFrame:
    """The entries of all buckets, each made by one task from the probes that its slots name."""
    slot = F.shiftrightunsigned("h", 64 - depth).cast("long") if depth else F.lit(0).cast("long")
    owned = probes.withColumn("slot", slot).join(slots.select("slot", "bucket"), "slot").repartition("bucket")
    chain = Window.partitionBy("bucket", "h").orderBy("digest", "norm")
    before = F.lag(F.struct("digest", "norm")).over(chain)
    owned = owned.withColumns({"chain": F.row_number().over(chain) - 1, "_before": before})
    clash = (F.col("_before.digest") == F.col("digest")) & ~F.col("_before.norm").eqNullSafe(F.col("norm"))
    fail = F.raise_error(F.lit("different texts share hash and digest")).cast("int")
    checked = F.when(F.coalesce(clash, F.lit(False)), fail).otherwise(F.col("chain"))
    return owned.select("bucket", "h", "digest", "n", "best", checked.alias("chain"))


def keepers(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, bucket, chain) of every row.

    Of equal texts the row with the most code points, then the smallest doc_id, stays; if the
    same row occurs repeatedly, all its repeats count as staying here (``drop_copies``
    leaves one). A null text counts as empty, a null doc_id loses to any other. No rows, no
    result. Every row takes the entry that its bucket's owner has made for its text; a text with very
    many rows is one entry, and as both sides of that join are written tables, adaptive execution
    splits the rows of it.
    """
    return _kept(*build(docs, **options))


def _kept(rows: DataFrame, index: DataFrame) -> DataFrame:
    keep = index.select("h", "digest", "n", "bucket", "chain", F.bitwise_not("best.minus").alias("keep_id"), F.col("best.code_points").alias("_cp"))
    return rows.join(keep, ["h", "digest"]).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("code_points") == F.col("_cp"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "bucket",
        F.col("chain").cast("long").alias("chain"),
        "key",
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns as they are. Of
    repeated rows one stays; among copies that all lack a doc_id, one of each wording."""
    rows, index = build(docs, **options)
    verdict = saved(_kept(rows, index).select("doc_id", "key", "kept"), "exact-verdict")
    for spent in (rows, index):
        discard(spent)
    repeated = verdict.where("kept").groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    return without(docs, verdict.where("not kept"), repeated)
