"""Structured Streaming counterparts of the incremental stages.

State is bounded where the semantics allow it: windows by a watermark, deduplication within it. The
unbounded forms (`exact=True`) keep every key, as a table with a unique constraint would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files under a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedup_by_content(docs: DataFrame, text: str = "raw_content", at: str | None = None, delay: str = "7 days", exact: bool = True) -> DataFrame:
    """First sight of every content hash; within the watermark only if not exact."""
    hashed = docs.withColumn("content_hash", F.sha2(text, 256))
    if exact or at is None:
        return hashed.dropDuplicates(["content_hash"])
    return hashed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["content_hash"])


def once_only_alerts(hits: DataFrame, keys: tuple[str, ...] = ("event_id", "persona", "rule")) -> DataFrame:
    """Each alert the first time it is seen."""
    return hits.dropDuplicates(list(keys))


def daily_observations(seen: DataFrame, at: str, keys: list[str], delay: str = "2 days") -> DataFrame:
    """One observation a key and day: the day's first, once the watermark has passed it."""
    day = F.window(at, "1 day")
    return seen.withWatermark(at, delay).groupBy(*keys, day).agg(F.min(at).alias("observed_at")).select(*keys, F.to_date("window.start").alias("day"), "observed_at")


def tumbling_counts(events: DataFrame, at: str, kind: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by window and kind."""
    return events.withWatermark(at, delay).groupBy(F.window(at, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """A key's events apart by less than the gap."""
    return events.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def append_new(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends rows whose key the table lacks; a replayed batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            stored = spark.read.schema(batch.schema).parquet(path)
            fresh = fresh.join(stored.select(*keys), keys, "left_anti").select(*batch.columns)
        except Exception as e:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return write
