"""Written intermediate tables and a membership filter of fixed size, with DataFrames only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import shared_path

PAGE_BITS = 15
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
#: A filter has at most this many bits (16 MB); a fuller one lets more rows through.
MAX_BITS = 27
#: Below that size, bits per key: one row in 32 or fewer passes that is no member.
BITS_PER_KEY = 32
#: No more keys than this can hold one row in so many each.
FREQUENT = 4096


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps do not repeat the
    work, whichever executors are lost, and both sides of a join are plain exchanges."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def in_batches(rows: DataFrame) -> DataFrame:
    """``rows``, after seeing to it that Python gets batches of at most ``BATCH_BYTES``: with
    the usual 64 MB a task holds several times that beside its heap."""
    spark = rows.sparkSession
    in_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if in_bytes(spark.conf.get(BATCH_SETTING)) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return rows


def discard(df: DataFrame) -> None:
    """Deletes a table written by ``saved`` that nothing will read any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def looked_up(rows: DataFrame, table: DataFrame, key: str, held: str) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row for each ``key`` and in ``held``
    the number of rows with it. ``rows`` is a written table, as it is read twice.

    Keys that hold one row in FREQUENT or more are at most FREQUENT, whatever the data, so they
    are broadcast and their rows stay where they are. All other keys meet in a shuffle
    in which none of them is large. Rows without a key meet nothing.
    """
    total = table.agg(F.sum(held)).first()[0] or 0
    often = F.col(held) * FREQUENT >= total
    values = [c for c in table.columns if c not in (key, held)]
    hot = table.where(often).select(F.col(key).alias("_hot"), *(F.col(c).alias(f"_{c}") for c in values))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    done = met.where(f"_hot is not null or {key} is null").select(*rows.columns, *(F.col(f"_{c}").alias(c) for c in values))
    rest = met.where(f"_hot is null and {key} is not null").select(*rows.columns)
    rare = table.where(~often).select(F.col(key).alias("_rare"), *values)
    return done.union(rest.join(rare, F.col(key) == F.col("_rare"), "left").select(*rows.columns, *values))


class Members:
    """Which rows may have a key of a given set: a bit for each hashed key.

    ``maybe`` never misses a member; a row that is none passes with a small chance, so
    what follows must still join on the keys. The bits are a table of 4 KB pages, never
    more than 4096 of them whatever the number of keys, hence safe to broadcast. The leading
    bits of ``hashed`` must be spread evenly.
    """

    def __init__(self, keys: DataFrame, hashed: Column):
        keys = keys.select(hashed.alias("_h"))
        n = keys.count()
        self.bits = min(MAX_BITS, max(PAGE_BITS, (BITS_PER_KEY * n).bit_length()))
        at = self._at(F.col("_h"))
        self.pages = keys.groupBy(self._page(at).alias("_page")).agg(
            F.bitmap_construct_agg(self._place(at).cast("long")).alias("_bits")
        )

    def _at(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - self.bits)

    @staticmethod
    def _page(at: Column) -> Column:
        return F.shiftright(at, PAGE_BITS)

    @staticmethod
    def _place(at: Column) -> Column:
        return at.bitwiseAND(F.lit((1 << PAGE_BITS) - 1))

    def mark(self, df: DataFrame, hashed: Column, name: str) -> DataFrame:
        """``df`` with a boolean column ``name``: may the row be a member?"""
        at = self._at(hashed)
        place = self._place(at).cast("int")
        byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10)
        bit = F.getbit(byte.cast("int"), place.bitwiseAND(F.lit(7))) == 1
        pages = F.broadcast(self.pages)
        return (
            df.join(pages, self._page(at) == F.col("_page"), "left")
            .withColumn(name, F.coalesce(bit, F.lit(False)))
            .drop("_page", "_bits")
        )


def text_key(text: str = "text") -> Column:
    """Tells rows with one doc_id apart; with the doc_id it names a row up to repeats."""
    return F.xxhash64(F.col(text).cast("string"))


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``docs`` less the rows named by ``gone`` (doc_id, key), all columns as they are.

    Of rows named by ``repeated`` one stays. Only rows that a filter of fixed size points at
    are shuffled, all others pass where they are read. Columns of ``docs`` may have any name.
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("key"))
    named = gone.select("doc_id", "key")
    if repeated is not None:
        named = named.union(repeated.select("doc_id", "key"))
    marked = Members(named, F.xxhash64("doc_id", "key")).mark(rows, F.xxhash64("id", "key"), "maybe")
    off = gone.select(F.col("doc_id").alias("their_id"), F.col("key").alias("their_key"))
    stay = marked.where("maybe").join(
        off, F.col("id").eqNullSafe(F.col("their_id")) & (F.col("key") == F.col("their_key")), "left_anti"
    )
    if repeated is not None:
        stay = stay.groupBy("id", "key").agg(F.first("row").alias("row"))
    return stay.select("row.*").union(marked.where("not maybe").select("row.*"))
