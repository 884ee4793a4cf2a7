import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lamina.operators.asof import as_of, interval_nodes, latest_rows

T0 = datetime(2023, 1, 1)


def call(ev, ver, **kw):
    return as_of(ev, ver, event_id=["id"], event_entity=F.col("who"), event_at="at", version_entity=F.col("who"), valid_from="f", valid_to="t", take=["k"], **kw)


@pytest.mark.parametrize("hot_parts", [1, 8, 100_000])
@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_matches_brute_force_with_either_join(spark, hot_parts, threshold):
    rng = random.Random(1)
    tm = lambda: T0 + timedelta(seconds=rng.randrange(40_000_000))
    ver = []
    for k in range(300):
        a, b = tm(), tm()
        ver.append((f"d{rng.randrange(20)}", min(a, b), max(a, b) if rng.random() < 0.9 else datetime(9999, 12, 31), k))
    ev = [(i, f"d{rng.randrange(22)}", tm()) for i in range(800)] + [(900 + i, v[0], v[1]) for i, v in enumerate(ver[:60])] + [(1000 + i, v[0], v[2]) for i, v in enumerate(ver[:60])]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    got = rows(call(spark.createDataFrame(ev, "id int, who string, at timestamp"), spark.createDataFrame(ver, "who string, f timestamp, t timestamp, k int"), hot_parts=hot_parts))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = []
    for i, w, at in ev:
        hit = [v for v in ver if v[0] == w and v[1] <= at < v[2]]
        if hit:
            want.append((i, min(hit, key=lambda v: (-v[1].timestamp(), v[3]))[3]))
    assert got == sorted(want)


def test_nodes_cover_exactly(spark):
    data = [(i, T0 + timedelta(seconds=a), T0 + timedelta(seconds=b)) for i, (a, b) in enumerate([(0, 1), (5, 5), (9, 3), (0, 2**20), (12345, 999_999), (1, 2**25 + 7)])]
    n = interval_nodes(spark.createDataFrame(data, "i int, f timestamp, t timestamp"), "f", "t", floor=0).collect()
    from lamina.operators.asof import SHIFT

    for i, f, t in data:
        parts = sorted((r._node << r._level, (r._node + 1) << r._level) for r in n if r.i == i)
        lo, hi = int(f.timestamp()) + SHIFT, int(t.timestamp()) + SHIFT
        if lo >= hi:
            assert not parts
            continue
        assert parts[0][0] == lo and parts[-1][1] == hi and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) <= 2 * 40


def test_edges_nulls_repeats_and_clashing_names(spark):
    ver = spark.createDataFrame([("a", T0, T0 + timedelta(days=1), 1, "x"), ("a", T0, T0 + timedelta(days=1), 1, "y"), (None, T0, T0, 2, "z"), ("a", None, T0, 3, "z")], "who string, f timestamp, t timestamp, k int, at string")
    ev = spark.createDataFrame([(1, "a", T0, 7), (2, "a", T0 + timedelta(days=1), 7), (3, None, T0, 7), (4, "a", None, 7)], "id int, who string, at timestamp, k int")
    assert rows(call(ev, ver)) == [(1, 1)]
    both = as_of(ev, ver.withColumnRenamed("k", "id"), event_id=["id"], event_entity=F.col("who"), event_at="at", version_entity=F.col("who"), valid_from="f", valid_to="t", take=["id"])
    assert both.columns == ["id", "id_version"] and rows(both) == [(1, 1)]
    assert rows(call(ev.limit(0), ver)) == [] and rows(call(ev, ver.limit(0))) == []


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "q")], "k string, o int, v string")
    assert rows(latest_rows(df, F.col("k"), "o", ["v"], "k")) == [("a", "z"), ("b", "q")]
