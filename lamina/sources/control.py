"""Load control: registry, watermarks, batch and error logs, freshness. Plain functions over small tables.

A batch runs RUNNING -> STAGED -> SUCCESS, or ends NO_DATA or FAILED. Watermarks move only when a
staged batch is committed, together with its status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_WATERMARK = "1900-01-01 00:00:00"
BATCH = "batch_id string, pipeline_name string, source_system string, entity_name string, target_table string, load_type string, watermark_from string, watermark_to string, status string, rows_read long, rows_written long, duration_seconds long, error_message string, start_ts timestamp, end_ts timestamp"
REGISTRY = "source_system string, entity_name string, connection_type string, target_table string, load_type string, watermark_column string, key_columns string, is_active boolean, sla_minutes int, priority int"
#: how each kind of source is read (fixed values)
CONNECTION_TYPES = ("relational", "api", "csv", "json", "message", "spreadsheet")
NEXT = {"RUNNING": ("STAGED", "FAILED", "NO_DATA"), "STAGED": ("SUCCESS", "FAILED"), "SUCCESS": (), "FAILED": (), "NO_DATA": ()}
_KEY = ["source_system", "entity_name"]


def source_registry(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Registry from one dict per entity; what a row leaves out is null, active, and loaded in full.

    Raises on an unknown connection type, on a repeated entity and on an incremental entity without watermark column.
    """
    names = [c.split()[0] for c in REGISTRY.split(", ")]
    full = [{"is_active": True, "load_type": "full", "priority": 1} | r for r in rows]
    keys = [(r["source_system"], r["entity_name"]) for r in full]
    for r, k in zip(full, keys, strict=True):
        if r["connection_type"] not in CONNECTION_TYPES:
            raise ValueError(f"{k}: unknown connection type {r['connection_type']}")
        if r["load_type"] == "incremental" and not r.get("watermark_column"):
            raise ValueError(f"{k}: an incremental entity needs a watermark column")
    if len(set(keys)) < len(keys):
        raise ValueError("entities repeat")
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], REGISTRY)


def entities_to_ingest(registry: DataFrame, watermarks: DataFrame, connection_type: str | None = None) -> DataFrame:
    """Active entities with their watermark, in order."""
    r = registry.filter("is_active")
    if connection_type:
        r = r.filter(F.col("connection_type") == connection_type)
    w = watermarks.select(*_KEY, "watermark_value")
    return r.join(w, _KEY, "left").withColumn("watermark_value", F.coalesce("watermark_value", F.lit(DEFAULT_WATERMARK))).orderBy(*_KEY)


def batch_start(log: DataFrame, *, batch_id: str, now: str, **fields: str) -> DataFrame:
    row = {c.split()[0]: None for c in BATCH.split(", ")} | fields | {"batch_id": batch_id, "status": "RUNNING"}
    one = log.sparkSession.createDataFrame([tuple(row.values())], BATCH).withColumn("start_ts", F.lit(now).cast("timestamp"))
    return log.unionByName(one)


def batch_end(log: DataFrame, *, batch_id: str, status: str, now: str, rows_read: int = 0, rows_written: int = 0, error: str | None = None) -> DataFrame:
    """The log with the batch ended; a batch that cannot go to ``status`` stays as it is."""
    may = F.col("status").isin(*[s for s, t in NEXT.items() if status in t]) & (F.col("batch_id") == batch_id)
    ts = F.lit(now).cast("timestamp")
    new = {"status": F.lit(status), "rows_read": F.lit(rows_read).cast("long"), "rows_written": F.lit(rows_written).cast("long"), "error_message": F.lit(error).cast("string"), "end_ts": ts, "duration_seconds": ts.cast("long") - F.col("start_ts").cast("long")}
    return log.select(*[F.when(may, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in log.columns])


def commit_staged(log: DataFrame, watermarks: DataFrame, *, now: str) -> tuple[DataFrame, DataFrame]:
    """(log, watermarks) after all STAGED batches became SUCCESS and their watermarks moved, never backwards."""
    moved = log.filter("status = 'STAGED' AND watermark_to IS NOT NULL").groupBy(*_KEY).agg(F.max("watermark_to").alias("_to"), F.max_by("batch_id", "watermark_to").alias("_by"))
    w = watermarks.select(*_KEY, "watermark_value", "last_batch_id", "updated_ts").join(moved, _KEY, "full")
    go = F.col("_to").isNotNull() & (F.col("watermark_value").isNull() | (F.col("_to") > F.col("watermark_value")))
    w = w.select(*_KEY, F.when(go, F.col("_to")).otherwise(F.col("watermark_value")).alias("watermark_value"), F.when(go, F.col("_by")).otherwise(F.col("last_batch_id")).alias("last_batch_id"), F.when(go, F.lit(now).cast("timestamp")).otherwise(F.col("updated_ts")).alias("updated_ts"))
    return log.withColumn("status", F.when(F.col("status") == "STAGED", "SUCCESS").otherwise(F.col("status"))), w


def reset_watermark(watermarks: DataFrame, system: str, entity: str | None = None) -> DataFrame:
    gone = F.col("source_system") == system
    if entity is not None:
        gone = gone & (F.col("entity_name") == entity)
    return watermarks.filter(~gone)


def log_error(errors: DataFrame, **fields: str) -> DataFrame:
    names = errors.columns
    return errors.unionByName(errors.sparkSession.createDataFrame([tuple(fields.get(c) for c in names)], errors.schema))


def latest_watermark(watermarks: DataFrame, entity: str, default: str = DEFAULT_WATERMARK) -> str:
    top = watermarks.filter(F.col("entity_name") == entity).orderBy(F.desc("updated_ts")).limit(1).collect()
    return top[0]["watermark_value"] if top else default


def freshness_status(status: Column, end_ts: Column, sla_minutes: Column, now: Column) -> Column:
    """NEVER_RUN without an end, FAILED unless the last batch went well, STALE beyond the SLA, else OK."""
    end = end_ts.cast("timestamp")
    late = (now.cast("long") - end.cast("long")) / 60 > sla_minutes
    return F.when(end_ts.isNull(), "NEVER_RUN").when(~status.isin("SUCCESS", "NO_DATA"), "FAILED").when(late, "STALE").otherwise("OK")


def freshness(registry: DataFrame, log: DataFrame, now: str) -> DataFrame:
    last = log.groupBy(*_KEY).agg(F.max_by(F.struct("status", "end_ts"), "start_ts").alias("_l"))
    return registry.filter("is_active").join(last, _KEY, "left").select(*_KEY, "sla_minutes", F.col("_l.end_ts").alias("last_end_ts"), freshness_status(F.col("_l.status"), F.col("_l.end_ts"), F.col("sla_minutes"), F.lit(now).cast("timestamp")).alias("freshness"))


def run_history(log: DataFrame, n: int = 1_000) -> DataFrame:
    return log.orderBy(F.desc("start_ts"), "batch_id").limit(n)


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BATCH)
