"""Ingest as a stream: bodies in files, validated and stored in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.validate import accepted, rejected, validate
from tidelog.sources.envelope import exploded
from tidelog.sources.store import STREAM, LogStore


def read_bodies(spark: SparkSession, path: str, max_files: int = 64, max_bytes: str | None = None) -> DataFrame:
    """(source, body): each file in `path` is one request body. The limits bound a micro-batch,
    which is the stream's way of holding back a fast producer."""
    reader = spark.readStream.format("text").option("wholetext", "true")
    reader = reader.option("maxBytesPerTrigger", max_bytes) if max_bytes else reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("body"))


def store_batch(store: LogStore, given: DataFrame, batch_id: int, now: int | None = None, reject_path: str | None = None) -> dict:
    """Validate and store one batch. Running it again with the same id changes nothing: clock and
    first id are on record, and every write replaces the batch's own directories."""
    record = store.begin(batch_id, now)
    checked = validate(exploded(given), record["now"]).drop("entry").persist()
    try:
        if reject_path:
            rejected(checked).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(reject_path)
        return store.append(batch_id, accepted(checked), record)
    finally:
        checked.unpersist()


def start(store: LogStore, given: DataFrame, checkpoint: str, once: bool = True, every: str = "1 second", now: int | None = None, stream: int = 0) -> StreamingQuery:
    """No watermark: any past time is stored and counted, and since counts add up no state is kept. `now` fixes the clock, else each batch takes its own.
    Streams into one store differ in `stream`, up to 256 of them; direct callers have batch ids of their own."""
    first = stream * STREAM
    writer = given.writeStream.foreachBatch(lambda rows, i: store_batch(store, rows, first + i, now, reject_path=f"{store.path}/rejected")).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def drain(query: StreamingQuery) -> None:
    """End after all that has arrived is stored."""
    query.processAllAvailable()
    query.stop()
