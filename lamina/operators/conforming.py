"""Row selection, code mapping, keys, slowly changing dimensions and lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.scalar import UNKNOWN_KEY, row_hash_of, std_string
from lamina.operators.asof import as_of
from lamina.session import pin

LOW, HIGH = "1900-01-01 00:00:00", "9999-12-31 23:59:59"


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest in ``order`` (later columns settle ties). Nulls count as lowest.

    An aggregate with map-side combine rather than a window, so a hot key costs no more than others.
    """
    rest = [c for c in df.columns if c not in keys]
    first = [F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]
    best = df.groupBy(*keys).agg(F.max(F.struct(*first, F.struct(*rest).alias("_r"))).alias("_m"))
    return best.select(*keys, *[F.col(f"_m._r.{c}").alias(c) for c in rest]).select(*df.columns)


def survive(df: DataFrame, keys: list[str], attributes: list[str], updated: str, rank: str) -> DataFrame:
    """Field by field the newest non-null value, then the best-ranked source, in one aggregate."""
    order = F.struct(F.coalesce(F.unix_micros(F.col(updated).cast("timestamp")), F.lit(-(2**62))).alias("u"), (-F.col(rank)).alias("r"))
    pick = [F.max(F.when(F.col(a).isNotNull(), F.struct(order.alias("o"), F.col(a).alias("v"))))["v"].alias(a) for a in attributes]
    return df.groupBy(*keys).agg(*pick)


def surrogate_keys(df: DataFrame, order: list[str], key: str, start: int = 0) -> DataFrame:
    """Dense keys from ``start + 1`` in the order of ``order``, without a single-partition window.

    Rows are range-partitioned by the order and pinned; a row's place in its partition plus the sizes of the
    partitions before it is its key, so nothing is shuffled a second time.
    """
    place = F.monotonically_increasing_id()  # partition number in the upper bits, place in it in the lower 33
    laid = pin(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = laid.select("*", place.alias("_at"))
    sizes = {r["p"]: r["n"] for r in at.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}  # one row per partition
    before, offset = [], start
    for p in range(max(sizes, default=-1) + 1):
        before.append(offset)
        offset += sizes.get(p, 0)
    if not before:
        return laid.withColumn(key, F.lit(None).cast("long"))
    base = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.shiftright("_at", 33).cast("int"))
    return at.withColumn(key, base + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at")


def map_codes(df: DataFrame, mapping: DataFrame, *, domain: str, system: str, source: str, target: str) -> DataFrame:
    """``target`` from the code table (one row per code; duplicates collapse), UNKNOWN where none applies."""
    m = mapping.filter((F.col("domain") == domain) & (F.col("source_system") == system) & (F.lower(F.col("is_active").cast("string")) == "true"))
    m = m.groupBy(std_string("source_code").alias("_code")).agg(F.min("standard_code").alias("_std"))
    return df.join(m, std_string(source) == F.col("_code"), "left").withColumn(target, F.coalesce("_std", F.lit("UNKNOWN"))).drop("_code", "_std")


def map_codes_by_system(df: DataFrame, mapping: DataFrame, *, domain: str, system: str, source: str, target: str) -> DataFrame:
    """Like :func:`map_codes`, with the system in a column of each row: rows of several systems in one pass."""
    m = mapping.filter((F.col("domain") == domain) & (F.lower(F.col("is_active").cast("string")) == "true"))
    m = m.groupBy(F.col("source_system").alias("_sys"), std_string("source_code").alias("_code")).agg(F.min("standard_code").alias("_std"))
    hit = (F.col(system) == F.col("_sys")) & (std_string(source) == F.col("_code"))
    return df.join(m, hit, "left").withColumn(target, F.coalesce("_std", F.lit("UNKNOWN"))).drop("_sys", "_code", "_std")


def resolve(df: DataFrame, xref: DataFrame, candidates: list[Column], *, uid: str, golden: str, out: str) -> DataFrame:
    """Golden id by the first candidate uid that the cross-reference knows."""
    cols = df.columns
    x = xref.groupBy(uid).agg(F.min(golden).alias("_g"))
    hits = []
    for i, c in enumerate(candidates):
        df = df.withColumn(f"_u{i}", c).join(x.select(F.col(uid).alias(f"_k{i}"), F.col("_g").alias(f"_g{i}")), F.col(f"_u{i}") == F.col(f"_k{i}"), "left")
        hits.append(F.col(f"_g{i}"))
    return df.select(*cols, F.coalesce(*hits).alias(out))


def lookup_current(fact: DataFrame, dim: DataFrame, *, business_key: Column | str, dim_business_key: str, dim_key: str, out: str, current: str | None = "is_current") -> DataFrame:
    """Surrogate key of the current member, -1 where there is none. Of several current rows the greatest key counts."""
    d = dim.filter(F.col(current)) if current and current in dim.columns else dim
    d = d.filter(F.col(dim_business_key).isNotNull()).groupBy(F.col(dim_business_key).alias("_bk")).agg(F.max(dim_key).alias("_key"))
    bk = F.col(business_key) if isinstance(business_key, str) else business_key
    return fact.join(d, bk == F.col("_bk"), "left").withColumn(out, F.coalesce("_key", F.lit(UNKNOWN_KEY))).drop("_bk", "_key")


def lookup_at(fact: DataFrame, dim: DataFrame, *, business_key: Column | str, at: str, dim_business_key: str, dim_key: str, out: str) -> DataFrame:
    """Surrogate key of the version valid at the event, -1 where there is none; never more rows than ``fact`` has.

    Each pair of key and instant is asked once, through :func:`as_of`: of overlapping versions the one that
    began last wins, then the smallest key.
    """
    bk = F.col(business_key) if isinstance(business_key, str) else business_key
    f = fact.withColumns({"_bk": bk.cast("string"), "_ts": F.col(at).cast("timestamp")})
    asked = f.select("_bk", "_ts").distinct()
    found = as_of(asked, dim, event_id=["_bk", "_ts"], event_entity=F.col("_bk"), event_at="_ts", version_entity=F.col(dim_business_key).cast("string"), valid_from="effective_from_ts", valid_to="effective_to_ts", take=[dim_key])
    found = found.select(F.col("_bk").alias("_k"), F.col("_ts").alias("_t"), F.col(dim_key).alias("_key"))
    hit = (F.col("_bk") == F.col("_k")) & (F.col("_ts") == F.col("_t"))
    return f.join(found, hit, "left").withColumn(out, F.coalesce("_key", F.lit(UNKNOWN_KEY))).drop("_bk", "_ts", "_k", "_t", "_key")


def seed_unknown(dim: DataFrame, *, key: str, business_key: str, extra: Mapping[str, object] | None = None, members: Mapping[int, str] | None = None) -> DataFrame:
    """Add the special members (-1 unknown, -2 not applicable, -3 late) that are not there yet."""
    spark = dim.sparkSession
    members = members or {-1: "UNKNOWN", -2: "NOT APPLICABLE", -3: "LATE ARRIVING"}
    rows = spark.createDataFrame([(k, v) for k, v in members.items()], f"{key} long, {business_key} string")
    for c, v in (extra or {}).items():
        rows = rows.withColumn(c, F.lit(v).cast(dim.schema[c].dataType))
    rows = rows.withColumn(key, F.col(key).cast(dim.schema[key].dataType)).withColumn(business_key, F.col(business_key).cast(dim.schema[business_key].dataType))
    return dim.unionByName(rows.join(dim.select(key).filter(F.col(key) < 0), key, "left_anti"), allowMissingColumns=True)


def scd1_merge(current: DataFrame, incoming: DataFrame, *, business_key: str, key: str) -> DataFrame:
    """New attribute values in place; existing keys stay, new members get the next ones."""
    inc = incoming.dropDuplicates([business_key])
    known = current.filter(F.col(key) >= 0).select(business_key, key)
    top = known.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    kept = inc.join(known, business_key)
    gone = current.join(inc.select(business_key), business_key, "left_anti")
    fresh = surrogate_keys(inc.join(known, business_key, "left_anti"), [business_key], key, top)
    return kept.unionByName(fresh.select(*kept.columns)).unionByName(gone.select(*kept.columns))


def scd2_merge(current: DataFrame | None, incoming: DataFrame, *, business_key: str, tracked: list[str], key: str, run_ts: str, close_absent: bool = False) -> DataFrame:
    """The whole dimension after a load: (current, incoming) -> new table.

    Unchanged members keep their version (attributes outside ``tracked`` are refreshed); a changed
    member's version ends at ``run_ts`` and a new one begins there; a new member begins
    at the low date, so that its earlier facts find it. Loading the same input twice changes nothing.
    With ``close_absent`` the current version of a member that is not delivered ends too.
    """
    run, low, high = (F.lit(x).cast("timestamp") for x in (run_ts, LOW, HIGH))
    inc = incoming.dropDuplicates([business_key]).withColumn("_hash", row_hash_of(tracked))
    attrs = [c for c in incoming.columns if c != business_key]
    shape = [key, business_key, *attrs, "effective_from_ts", "effective_to_ts", "is_current", "row_hash"]

    def version(df: DataFrame, start: Column) -> DataFrame:
        return df.select(business_key, *attrs, start.alias("effective_from_ts"), high.alias("effective_to_ts"), F.lit(True).alias("is_current"), F.col("_hash").alias("row_hash"))

    if current is None:
        return surrogate_keys(version(inc, low), [business_key], key).select(*shape)
    old = current.select(*shape)
    top = old.agg(F.coalesce(F.max(F.when(F.col(key) >= 0, F.col(key))), F.lit(0))).first()[0]
    live = old.filter(F.col("is_current") & (F.col(key) >= 0))
    fixed = old.filter(~(F.col("is_current") & (F.col(key) >= 0)))
    i = inc.select(F.col(business_key).alias("_bk"), F.col("_hash").alias("_new"), F.struct(*attrs).alias("_in"))
    m = live.join(i, F.col(business_key) == F.col("_bk"), "left")
    same = F.col("_new") == F.col("row_hash")
    ends = F.col("_new").isNotNull() & ~same
    if close_absent:
        ends = ends | F.col("_new").isNull()
    fresh_attr = [F.when(same, F.col(f"_in.{c}")).otherwise(F.col(c)).alias(c) for c in attrs]
    closed = m.select(key, business_key, *fresh_attr, "effective_from_ts", F.when(ends, run).otherwise(F.col("effective_to_ts")).alias("effective_to_ts"), F.coalesce(~ends, F.lit(True)).alias("is_current"), "row_hash")
    state = live.select(F.col(business_key).alias("_bk"), F.col("row_hash").alias("_old"))
    known = old.select(F.col(business_key).alias("_ever")).distinct()
    new = inc.join(state, F.col(business_key) == F.col("_bk"), "left").filter(F.col("_old").isNull() | (F.col("_old") != F.col("_hash"))).join(known, F.col(business_key) == F.col("_ever"), "left")
    begun = version(new, F.when(F.col("_ever").isNull(), low).otherwise(run))
    keyed = surrogate_keys(begun, [business_key], key, top)
    return closed.select(*shape).unionByName(fixed).unionByName(keyed.select(*shape))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Merge without a row-level table format: changed keys replace, new keys join."""
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*current.columns))


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
