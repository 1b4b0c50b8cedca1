"""Stream sources, and sinks that survive a restart.

Append streams go to the Parquet file sink. Update streams become a change log: every
micro-batch overwrites its own folder, so a replayed batch leaves no second copy, and the
current table is the newest change per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barloom.session import shared_path

BATCH = "batch"


#: Columns of the event table.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def tick_stream(
    spark: SparkSession, root: str, name: str = "events", files_per_batch: int | None = None
) -> DataFrame:
    """Ticks as a stream, from a table of one file or a folder of part files. Event time must
    be a zoned timestamp to carry a watermark."""
    stream = spark.readStream.schema(EVENTS)
    if files_per_batch is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    # a pattern that only the table's own path meets, which may be a file or a folder
    rows = stream.parquet(f"{root}/{name}.parque[t]")
    return rows.filter(F.col("value") > 0).select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("size"),
        F.col("event_id").alias("seq"),
    )


def start_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def start_changes(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return (
        df.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def read_table(spark: SparkSession, path: str, schema: T.StructType, batches=False) -> DataFrame:
    if batches:
        schema = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def drain_append(df: DataFrame, label: str) -> DataFrame:
    """Run an append stream over everything there is and return its table."""
    spark = df.sparkSession
    path, checkpoint = shared_path(spark, label), shared_path(spark, f"{label}-state")
    finish(start_append(df, path, checkpoint))
    return read_table(spark, path, df.schema)


def drain_changes(df: DataFrame, label: str) -> DataFrame:
    """Run an update stream over everything there is and return its change log."""
    spark = df.sparkSession
    path, checkpoint = shared_path(spark, label), shared_path(spark, f"{label}-state")
    finish(start_changes(df, path, checkpoint))
    return read_table(spark, path, df.schema, batches=True)


def current(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Newest change per key, folded map-side."""
    rest = [c for c in changes.columns if c not in keys and c != BATCH]
    rows = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_r"))
    return rows.select(*keys, "_r.*")


def first_seen(changes: DataFrame, keys: list[str]) -> DataFrame:
    """First change per key: a new candle, or an alert that fires once."""
    rest = [c for c in changes.columns if c not in keys and c != BATCH]
    rows = changes.groupBy(*keys).agg(F.min_by(F.struct(*rest), BATCH).alias("_r"))
    return rows.select(*keys, "_r.*")
