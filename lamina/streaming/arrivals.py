"""File arrival: new landing files are committed as they come, each micro-batch through the batch commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamina.sources.commit import Entity, with_audit
from lamina.sources.store import TableStore


def message_files(spark: SparkSession, folder: str, pattern: str = "*", files_per_trigger: int = 1_000) -> DataFrame:
    """Stream of whole files: ``file, content``."""
    s = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger)
    s = s.schema("path string, modificationTime timestamp, length long, content binary")
    return s.load(folder).select(F.col("path").alias("file"), F.col("content").cast("string").alias("content"))


def commit_arrivals(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], store: TableStore, entity: Entity, *, checkpoint: str, load_date: str, now: str) -> StreamingQuery:
    """Parse and commit each micro-batch under its own batch id; a replayed micro-batch replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        df = with_audit(parse(batch), entity, batch_id=f"{entity.name}-{n}", now=now, load_date=load_date)
        store.reload_partitions(entity.target, df.withColumn("_epoch", F.lit(n)), "_epoch")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_within(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Repeated deliveries inside the delay dropped, with bounded state."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, by: list[str], *, size: str, slide: str | None = None, delay: str) -> DataFrame:
    """Event counts in tumbling or sliding windows; late events within the delay still count."""
    w = F.window(event_time, size, slide) if slide else F.window(event_time, size)
    return stream.withWatermark(event_time, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), *by, "events")
