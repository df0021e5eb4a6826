"""The upsert as a stream: files that arrive are merged batch by batch into a versioned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..operators import changelog, store


def incoming(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def exact_repeats_dropped(rows: DataFrame, time: str, key: list[str], late: str = "1 day") -> DataFrame:
    """Rows without those that repeat a key within the lateness allowed; the state is bounded by it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def upsert_into(rows: DataFrame, root: str, order: Column, checkpoint: str, minutes: int = 60) -> DataStreamWriter:
    """A writer that merges every batch by natural key and fingerprint; a batch that runs again finds its version published."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, batch_id + 1
        if version in store.versions(spark, root):
            return
        now = store.read(spark, root, version - 1)
        if now is None:
            now = store.upsert(batch.limit(0), _empty(batch), 0, order)[0]
        store.publish(store.upsert(batch, now, version, order)[0], root, version)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(processingTime=f"{minutes} minutes")


def merge_into(rows: DataFrame, root: str, order: Column | str, checkpoint: str, minutes: int = 60, key: str = "natural_key", fingerprint: str = "fingerprint") -> DataStreamWriter:
    """A writer that merges every batch into a change log: it writes the batch's own rows; a batch that runs again changes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        changelog.merge(batch, root, batch_id + 1, order, key, fingerprint)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(processingTime=f"{minutes} minutes")


def _empty(batch: DataFrame) -> DataFrame:
    return batch.limit(0).selectExpr("*", "0 as first_batch_id", "0 as last_batch_id")


def windowed_net(rows: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Net payments by event-time window, final once the watermark has passed."""
    from pyspark.sql import functions as F

    timed = rows.withWatermark(time, late)
    return timed.groupBy(F.window(time, window)).agg(F.sum(F.col("debit") - F.col("credit")).alias("net"), F.count("*").alias("legs"))
