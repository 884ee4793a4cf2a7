import random
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.operators.intervals import IntervalMap, spans

T0 = datetime(2024, 1, 1)
HIGH = datetime(9999, 12, 31)
DDL = "bed string, s timestamp, e timestamp, entity int, start_us string"


def brute(data):
    out = []
    for bed in {r[0] for r in data if r[0] is not None}:
        iv = sorted((r[1], r[2] or HIGH) for r in data if r[0] == bed and r[1] is not None and (r[2] or HIGH) > r[1])
        merged = []
        for s, e in iv:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(bed, "period", s, e) for s, e in merged] + [(bed, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


def run(spark, data, partitions=None):
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = spans(spark.createDataFrame(data, DDL), entity=F.col("bed"), start=F.col("s"), end=F.col("e")).collect()
        return sorted((r.entity, r.span_kind, r.start_ts, r.end_ts) for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=30))
def test_map_in_any_order(pairs):
    m = IntervalMap()
    for s, e in pairs:
        m.insert(s, e)
    cells = {x for s, e in pairs for x in range(s, e)}
    assert {x for s, e in m.periods() for x in range(s, e)} == cells
    assert all(a[1] < b[0] for a, b in zip(m.periods(), m.periods()[1:]))
    assert m.gaps() == [(a[1], b[0]) for a, b in zip(m.periods(), m.periods()[1:])] and len(m.gap_ends) == len(m.gaps())
    whole = [("period", *x) for x in m.periods()] + [("gap", *x) for x in m.gaps()]
    left = m.settle(20)
    assert sorted(left + [("period", *x) for x in m.periods()] + [("gap", *x) for x in m.gaps()]) == sorted(whole)
    assert all(e < 20 for k, _, e in left if k == "period")


def test_rules(spark):
    h = lambda n: T0 + timedelta(hours=n)
    data = [("a", h(0), h(2), 1, "x"), ("a", h(2), h(3), 1, "x"), ("a", h(5), h(5), 1, "x"), ("a", h(6), h(4), 1, "x"), ("a", h(7), None, 1, "x"), ("a", h(0), h(2), 1, "x"), (None, h(0), h(1), 1, "x"), ("b", None, h(1), 1, "x")]
    assert run(spark, data) == [("a", "gap", h(3), h(7)), ("a", "period", h(0), h(3)), ("a", "period", h(7), HIGH)]
    assert run(spark, []) == []


def test_hot_bed_over_many_partitions(spark):
    for seed, most in ((1, 40), (2, 4000), (3, 200_000)):
        rng = random.Random(seed)
        data = []
        for _ in range(900):
            s = T0 + timedelta(minutes=rng.randrange(200_000))
            data.append(("hot" if rng.random() < 0.7 else f"b{rng.randrange(9)}", s, s + timedelta(minutes=rng.randrange(1, most)) if rng.random() < 0.995 else None, 0, None))
        assert run(spark, data, 11) == brute(data)


def test_streaming_state_gives_the_same(spark, tmp_path):
    from lamina.streaming.intervals import spans_stream

    rng = random.Random(5)
    data = []
    for _ in range(120):
        s = T0 + timedelta(minutes=rng.randrange(2_000))
        data.append((f"b{rng.randrange(3)}", s, s + timedelta(minutes=rng.randrange(1, 60)), 0, None))
    for i in range(3):
        spark.createDataFrame(data[i * 40 : i * 40 + 40], DDL).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    seen = {}

    def keep(df, n):
        for e in {r.entity for r in df.select("entity").distinct().collect()}:
            seen[e] = sorted((r.entity, r.span_kind, r.s, r.t) for r in df.filter(F.col("entity") == e).select("entity", "span_kind", F.timestamp_micros("start_us").alias("s"), F.timestamp_micros("end_us").alias("t")).collect())

    q = spans_stream(stream, entity=F.col("bed"), start=F.col("s"), end=F.col("e")).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(x for v in seen.values() for x in v) == brute(data)


def test_settled_intervals_leave_the_map_early(spark, monkeypatch):
    from lamina.operators import intervals

    monkeypatch.setattr(intervals, "SETTLE", 3)
    data = [("a", T0 + timedelta(hours=3 * i), T0 + timedelta(hours=3 * i + 1 + (i % 5 == 0) * 7), 0, None) for i in range(200)]
    assert run(spark, data, 5) == brute(data)
