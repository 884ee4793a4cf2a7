"""Commit of staged extracts to the raw layer: envelope, audit columns, row hash, write mode by load type, reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.scalar import row_hash_of
from lamina.operators.quality import QualityGateError
from lamina.sources.files import unprefix
from lamina.sources.store import TableStore

AUDIT = ("_source_system", "_source_file", "_ingest_ts", "_batch_id", "_row_hash", "_entity_name", "_load_date")


@dataclass(frozen=True)
class Entity:
    source_system: str
    name: str
    target: str
    load_type: str = "full"  # full replaces the day, incremental appends
    envelope: str | None = None  # 'array' for a struct array column named data, 'dotted' for data.* columns


def with_audit(df: DataFrame, e: Entity, *, batch_id: str, now: str, load_date: str, file: str | None = None) -> DataFrame:
    """Payload as strings plus audit columns; the hash covers the payload only."""
    if e.envelope == "array":
        df = df.select(F.explode("data").alias("r")).select("r.*")
    elif e.envelope == "dotted":
        df = unprefix(df)
    payload = [c for c in df.columns if c not in AUDIT]
    df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in payload])
    return df.withColumns({
        "_source_system": F.lit(e.source_system), "_source_file": F.lit(file).cast("string"), "_ingest_ts": F.lit(now).cast("timestamp"), "_batch_id": F.lit(batch_id),
        "_row_hash": row_hash_of([F.col(f"`{c}`") for c in payload]), "_entity_name": F.lit(e.name), "_load_date": F.lit(load_date).cast("date"),
    })


def commit(store: TableStore, staged: DataFrame, e: Entity, *, batch_id: str, now: str, load_date: str) -> dict:
    """Write one entity and check that every staged row arrived; returns the metrics."""
    df = with_audit(staged, e, batch_id=batch_id, now=now, load_date=load_date)
    if e.load_type == "full":
        store.reload_partitions(e.target, df, "_load_date")
    else:
        store.append(e.target, df, "_load_date")
    n, m = df.count(), store.read(e.target).filter(F.col("_batch_id") == batch_id).count()
    if n != m:
        raise QualityGateError(f"{e.target}: {n} rows staged, {m} committed")
    return {"entity": e.name, "target": e.target, "rows_written": m, "batch_id": batch_id}
