"""Attributes as known at event time (problem 2): interval lookup over dyadic time nodes.

A validity interval [from, to), cut to the time the events span, is decomposed into dyadic nodes
(level l, node n) that cover [n * 2**l, (n + 1) * 2**l) seconds, at most two per level. An event
lies in exactly one node of every level, so a pure equi-join on (entity, level, node) finds every
interval that holds it: no range join. An event asks only for the levels its entity has nodes of.
An entity that holds more than one event in 256 is salted: its events split into parts, and its
nodes are there for each part. Nodes finer than ``floor_level`` are not cut; there the exact
half-open test decides. The optimizer may still broadcast a side it knows to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.hot import HOT_PARTS
from lamina.session import ship, written

#: 2**16 s is about 18 hours.
FLOOR_LEVEL = 16
#: 2**39 s is about 17,000 years: one node covers all representable time after the shift below.
TOP_LEVEL = 39
#: Seconds added so that all times from year 1 on are positive.
SHIFT = 62_135_596_800


def _nodes_sql(lo: str, hi: str, floor: int) -> str:
    """SQL of the array of (level, node) that covers seconds [lo, hi], both inclusive and shifted.

    Climbing from the floor level, the left edge is a node where it is a right child and the
    right edge where it is a left child; when the edges have crossed they stay far apart.
    """
    kind = "array<struct<level:int,node:bigint>>"
    nl, nr = "(s.l + s.l % 2)", "(s.r - 1 + s.r % 2)"
    over = f"(s.l > s.r or {nl} > {nr})"
    edge = lambda test, node: f"if(s.l <= s.r and {test}, array(named_struct('level', lev, 'node', {node})), cast(array() as {kind}))"
    return f"""
    aggregate(
      sequence({floor}, {TOP_LEVEL}),
      named_struct('l', shiftright({lo}, {floor}), 'r', shiftright({hi}, {floor}), 'out', cast(array() as {kind})),
      (s, lev) -> named_struct(
        'l', if({over}, {1 << 62}L, {nl} div 2),
        'r', if({over}, -1L, {nr} div 2),
        'out', concat(s.out, {edge("s.l % 2 = 1", "s.l")}, {edge("s.r % 2 = 0", "s.r")})),
      s -> s.out)"""


def interval_nodes(df: DataFrame, start: str, end: str, floor: int = FLOOR_LEVEL) -> DataFrame:
    """One row per dyadic node of each interval; empty and reversed intervals give none."""
    ok = df.filter(F.col(start) < F.col(end))
    lo, hi = f"(unix_seconds({start}) + {SHIFT}L)", f"(unix_seconds(cast({end} as timestamp) - interval 1 microsecond) + {SHIFT}L)"
    return ok.withColumn("_n", F.explode(F.expr(_nodes_sql(lo, hi, floor)))).select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")


def as_of(
    events: DataFrame,
    versions: DataFrame,
    *,
    event_id: list[str],
    event_entity: Column,
    event_at: str,
    version_entity: Column,
    valid_from: str,
    valid_to: str,
    take: list[str],
    floor: int = FLOOR_LEVEL,
    hot_parts: int = HOT_PARTS,
) -> DataFrame:
    """``event_id`` columns of each event plus ``take`` of the version that held at its time.

    Events without a version, and events or versions without entity or time, give no row. Where several versions
    hold, the one with the latest ``valid_from`` wins, then the smallest ``take`` values in
    column order; repeated versions are one. Clashing column names do not matter: both
    sides are renamed on entry, and a taken column named like an event key comes as ``<name>_version``. ``event_id`` must identify an event.
    """
    ship(events.sparkSession)
    v = (
        versions.select(version_entity.alias("_e"), F.col(valid_from).cast("timestamp").alias("_f"), F.col(valid_to).cast("timestamp").alias("_t"), F.struct(*take).alias("_v"))
        .filter("_e is not null and _f is not null and _t is not null")
        .distinct()
    )
    e = written(events.select(F.struct(*event_id).alias("_id"), event_entity.alias("_e"), F.col(event_at).cast("timestamp").alias("_at")).filter("_e is not null and _at is not null"))
    stat = e.agg(F.count("*").alias("n"), F.min("_at").alias("lo"), F.max("_at").alias("hi")).first()
    lo, hi = (F.lit(x).cast("timestamp") for x in (stat["lo"], stat["hi"]))
    # fewer than hot_parts entities, by the threshold
    most = max(1, stat["n"] // hot_parts)
    hot = [(r["_e"], r["n"]) for r in e.groupBy("_e").agg(F.ceil(F.count("*") / most).alias("n")).filter("n > 1").collect()]
    salts = F.lit(1).cast("long")
    if hot:
        parts = F.create_map(*[x for k, n in hot for x in (F.lit(k), F.lit(n).cast("long"))])
        salts = F.when(F.col("_e").isin(*[k for k, _ in hot]), F.element_at(parts, F.col("_e"))).otherwise(salts)
    cut = v.withColumns({"_a": F.greatest("_f", lo), "_b": F.least("_t", hi + F.expr("interval 1 second"))})
    nodes = interval_nodes(cut.filter((F.col("_f") < F.col("_t")) & (F.col("_f") <= hi) & (F.col("_t") > lo)), "_a", "_b", floor).drop("_a", "_b")
    # written, so that the optimizer broadcasts them by their size or not at all
    nodes = written(nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))))
    levels = nodes.filter("_salt = 0").groupBy("_e").agg(F.collect_set("_level").alias("_levels"))  # at most 24 numbers
    keyed = e.withColumn("_salt", F.pmod(F.xxhash64("_id", "_at"), salts)).join(levels, "_e").withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_node", F.expr(f"shiftright(unix_seconds(_at) + {SHIFT}L, _level)"))
    hit = keyed.join(nodes, ["_e", "_level", "_node", "_salt"]).filter((F.col("_f") <= F.col("_at")) & (F.col("_at") < F.col("_t")))
    best = hit.groupBy("_id").agg(F.min(F.struct((-F.unix_micros("_f")).alias("k"), F.col("_v"))).alias("b"))
    names = {c: f"{c}_version" if c in event_id else c for c in take}
    return best.select("_id.*", *[F.col(f"b._v.{c}").alias(n) for c, n in names.items()])


def latest_rows(df: DataFrame, key: Column, order: str, keep: list[str], key_name: str) -> DataFrame:
    """Per key the ``keep`` columns of the row with the greatest ``order`` (nulls lowest), ties by the greatest values."""
    best = df.select(key.alias(key_name), F.struct(F.col(order), *keep).alias("_r")).groupBy(key_name).agg(F.max("_r").alias("_r"))
    return best.select(key_name, *[F.col(f"_r.{c}").alias(c) for c in keep])
