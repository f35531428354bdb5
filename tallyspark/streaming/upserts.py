"""Incremental loads as Structured Streaming: each micro-batch is merged by key, exactly once a batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.operators.sync import upsert
from tallyspark.streaming.store import KeyedStore


def merged_stream(changes: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], parts: int | None = None) -> StreamingQuery:
    """Run what is available and stop. A batch that is replayed writes the same again.

    parts: the state is a keyed store of so many parts (store.py): a batch writes its changes to the parts with its keys, and its
    cost does not grow with the batches before it; state() reads it. Without it, for small state, each batch's table is whole (path/batch=n).
    """
    if parts:
        spark = changes.sparkSession
        spark.createDataFrame([(keys, order, parts)], "keys array<string>, `order` array<string>, parts int").coalesce(1).write.mode("overwrite").json(f"{path}/_keys")
        return KeyedStore(spark, path, changes.schema, keys, order, parts).follow(changes, checkpoint)

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/batch={batch_id - 1}") if batch_id else batch.limit(0)
        upsert(before, batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(like: DataFrame, path: str) -> DataFrame:
    """What merged_stream() with parts has merged so far; `like` has the columns of the changes."""
    told = like.sparkSession.read.schema("keys array<string>, `order` array<string>, parts int").json(f"{path}/_keys").first()
    return KeyedStore(like.sparkSession, path, like.schema, list(told["keys"]), list(told["order"]), told["parts"]).read()


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Extension: windowed counts of an event stream that tolerates late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
