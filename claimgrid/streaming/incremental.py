"""Incremental assembly with Structured Streaming: evidence arrives in files or topics, counts and beliefs stay up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evidence_counts(stream: DataFrame, event_time: str, watermark: str = "10 minutes", window: str = "1 hour", keys: tuple[str, ...] = ("mk_hash", "source_api", "negated")) -> DataFrame:
    """Evidence counts by key and window of event time; late rows within the watermark count. State is one row for each key and open window."""
    return stream.withWatermark(event_time, watermark).groupBy(F.window(event_time, window), *keys).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, event_time: str, keys: tuple[str, ...], watermark: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(keys))


def merge_counts(old: DataFrame | None, new: DataFrame, keys: tuple[str, ...] = ("mk_hash", "source_api", "negated")) -> DataFrame:
    """Counts so far and a batch's counts, summed."""
    both = new if old is None else old.unionByName(new)
    return both.groupBy(*keys).agg(F.sum("n").alias("n"))


def incremental_sink(base: str, keys: tuple[str, ...] = ("mk_hash", "source_api", "negated")):
    """A foreachBatch function that keeps a Parquet table of counts: version k + 1 is written beside version k, so a batch that is run again gives the same table."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy(*keys).agg(F.count("*").alias("n"))
        old = spark.read.parquet(f"{base}/v={epoch - 1}") if epoch > 0 else None
        merge_counts(old, fresh, keys).write.mode("overwrite").parquet(f"{base}/v={epoch}")

    return write
