"""Streaming form of the interval operator: one ordered interval map per entity as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.intervals import HIGH, IntervalMap
from lamina.session import ship

_OUT = "entity string, span_kind string, start_us long, end_us long"
_STATE = "starts array<bigint>, ends array<bigint>"


def _update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    m = IntervalMap(*(list(x) for x in state.get)) if state.exists else IntervalMap()
    for b in batches:
        for s, e in zip(b["start_us"], b["end_us"], strict=True):
            m.insert(int(s), int(e))
    state.update((m.starts, m.ends))
    rows = [(key[0], "period", s, e) for s, e in m.periods()] + [(key[0], "gap", s, e) for s, e in m.gaps()]
    yield pd.DataFrame(rows, columns=["entity", "span_kind", "start_us", "end_us"])


def spans_stream(stream: DataFrame, *, entity: Column, start: Column, end: Column, high: str = HIGH) -> DataFrame:
    """Update-mode stream: whenever an entity has new intervals, all its present periods and gaps.

    The state of an entity is its disjoint intervals, not its history. Late and repeated
    intervals merge like any other.
    """
    ship(stream.sparkSession)
    rows = stream.select(entity.cast("string").alias("entity"), F.unix_micros(start.cast("timestamp")).alias("start_us"), F.unix_micros(F.coalesce(end.cast("timestamp"), F.lit(high).cast("timestamp"))).alias("end_us")).filter(
        F.col("entity").isNotNull() & F.col("start_us").isNotNull() & (F.col("end_us") > F.col("start_us"))
    )
    return rows.groupBy("entity").applyInPandasWithState(_update, _OUT, _STATE, "update", "NoTimeout")
