import random
from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from lamina.operators import conforming as cf

HIGH = datetime(9999, 12, 31, 23, 59, 59)


def test_latest_and_survive(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", None), ("a", 2, "z", "k"), ("b", None, "q", None)], "id string, t int, v string, w string")
    assert rows(cf.latest(df, ["id"], ["t", "v"])) == [("a", 2, "z", "k"), ("b", None, "q", None)]
    s = spark.createDataFrame([("p", datetime(2024, 1, 2), 1, "new", None), ("p", datetime(2024, 1, 1), 1, "old", "kept"), ("p", datetime(2024, 1, 2), 2, "worse", None), ("q", None, 1, None, None)], "id string, u timestamp, r int, v string, w string")
    assert rows(cf.survive(s, ["id"], ["v", "w"], "u", "r")) == [("p", "new", "kept"), ("q", None, None)]


def test_surrogate_keys_are_dense_and_ordered(spark):
    v = list(range(500))
    random.Random(1).shuffle(v)
    df = spark.createDataFrame([(x,) for x in v], "x int").repartition(7)
    assert rows(cf.surrogate_keys(df, ["x"], "k", 10)) == [(x, x + 11) for x in range(500)]
    assert cf.surrogate_keys(df.limit(0), ["x"], "k").count() == 0


def test_map_codes_duplicates_do_not_fan_out(spark):
    m = spark.createDataFrame([("D", "S", "a", "A1", "true"), ("D", "S", " A ", "A1", "true"), ("D", "S", "b", "B1", "false"), ("X", "S", "c", "C1", "true")], "domain string, source_system string, source_code string, standard_code string, is_active string")
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert sorted((r.c or "", r.s) for r in cf.map_codes(df, m, domain="D", system="S", source="c", target="s").collect()) == [("", "UNKNOWN"), ("a", "A1"), ("b", "UNKNOWN")]


def dim(spark, data):
    return spark.createDataFrame(data, "bk string, a string, note string")


KW = {"business_key": "bk", "tracked": ["a"], "key": "k"}


def test_scd2_lifecycle(spark):
    d1 = cf.scd2_merge(None, dim(spark, [("x", "1", "n"), ("y", "1", "n"), ("y", "1", "n")]), run_ts="2024-01-01 00:00:00", **KW)
    again = cf.scd2_merge(d1, dim(spark, [("x", "1", "n2"), ("y", "1", "n")]), run_ts="2024-02-01 00:00:00", **KW)
    assert again.count() == 2 and {r.note for r in again.filter("bk = 'x'").collect()} == {"n2"}
    d2 = cf.scd2_merge(again, dim(spark, [("x", "2", "n"), ("z", "1", "n")]), run_ts="2024-03-01 00:00:00", **KW)
    run = datetime(2024, 3, 1)
    low = datetime(1900, 1, 1)
    assert rows(d2, "bk", "a", "effective_from_ts", "effective_to_ts", "is_current") == [("x", "1", low, run, False), ("x", "2", run, HIGH, True), ("y", "1", low, HIGH, True), ("z", "1", low, HIGH, True)]
    assert len({r.k for r in d2.collect()}) == 4
    gone = cf.scd2_merge(d2, dim(spark, [("x", "2", "n")]), run_ts="2024-04-01 00:00:00", close_absent=True, **KW)
    assert rows(gone.filter("is_current"), "bk") == [("x",)]
    back = cf.scd2_merge(gone, dim(spark, [("x", "2", "n"), ("y", "1", "n")]), run_ts="2024-05-01 00:00:00", **KW)
    assert rows(back.filter("bk = 'y' and is_current"), "effective_from_ts") == [(datetime(2024, 5, 1),)]


def test_five_changes_five_versions(spark):
    d = cf.scd2_merge(None, dim(spark, [(str(i), "a", "n") for i in range(50)]), run_ts="2024-01-01 00:00:00", **KW)
    d2 = cf.scd2_merge(d, dim(spark, [(str(i), "b" if i < 5 else "a", "n") for i in range(50)]), run_ts="2024-01-02 00:00:00", **KW)
    assert d2.count() == 55


def test_scd1_keeps_keys_and_seed_is_idempotent(spark):
    cur = spark.createDataFrame([("x", "1", 1), ("y", "1", 2), ("UNKNOWN", None, -1)], "bk string, a string, k long")
    out = cf.scd1_merge(cur, spark.createDataFrame([("y", "9"), ("z", "5")], "bk string, a string"), business_key="bk", key="k")
    assert rows(out, "bk", "a", "k") == sorted([("x", "1", 1), ("y", "9", 2), ("z", "5", 3), ("UNKNOWN", None, -1)])
    s = cf.seed_unknown(cf.seed_unknown(cur, key="k", business_key="bk"), key="k", business_key="bk")
    assert rows(s.filter("k < 0"), "k") == [(-3,), (-2,), (-1,)]


def test_lookups(spark):
    t = lambda m: datetime(2024, m, 1)
    d = spark.createDataFrame([(1, "a", t(1), t(3), False), (2, "a", t(3), HIGH, True)], "k int, bk string, effective_from_ts timestamp, effective_to_ts timestamp, is_current boolean")
    f = spark.createDataFrame([("a", t(2)), ("a", t(3)), ("a", datetime(2020, 1, 1)), ("q", t(2)), (None, t(2)), ("a", None)], "b string, at timestamp")
    got = cf.lookup_at(f, d, business_key="b", at="at", dim_business_key="bk", dim_key="k", out="key").collect()
    assert sorted(r.key for r in got) == [-1, -1, -1, -1, 1, 2]
    cur = cf.lookup_current(f, d, business_key="b", dim_business_key="bk", dim_key="k", out="key").collect()
    assert sorted(r.key for r in cur) == [-1, -1, 2, 2, 2, 2]


def test_resolve_in_order(spark):
    x = spark.createDataFrame([("SCHED|1", "g1"), ("EHR|1", "g2"), ("EHR|2", "g3")], "record_uid string, g string")
    df = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    got = cf.resolve(df, x, [F.concat(F.lit("SCHED|"), "id"), F.concat(F.lit("EHR|"), "id")], uid="record_uid", golden="g", out="golden")
    assert sorted((r.id, r.golden or "") for r in got.collect()) == [("1", "g1"), ("2", "g3"), ("3", "")]


def test_upsert(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert rows(cf.upsert(a, b, ["k"])) == [(1, "x"), (2, "z"), (3, "w")]


def test_overlapping_versions_do_not_multiply_facts(spark):
    ddl = "bk string, k long, effective_from_ts timestamp, effective_to_ts timestamp"
    t = lambda d: datetime(2024, 1, d)
    d = spark.createDataFrame([("a", 1, t(1), t(20)), ("a", 2, t(5), t(10)), ("a", 3, t(5), t(10)), (None, 9, t(1), t(20))], ddl)
    f = spark.createDataFrame([(1, "a", t(2)), (2, "a", t(6)), (2, "a", t(6)), (3, "a", t(12)), (4, "a", t(25)), (5, None, t(2)), (6, "a", None), (7, "b", t(2))], "id int, who string, at timestamp")
    got = rows(cf.lookup_at(f, d, business_key="who", at="at", dim_business_key="bk", dim_key="k", out="key"), "id", "key")
    assert got == [(1, 1), (2, 2), (2, 2), (3, 1), (4, -1), (5, -1), (6, -1), (7, -1)]
    cur = cf.lookup_current(f, d.withColumn("is_current", F.lit(True)), business_key="who", dim_business_key="bk", dim_key="k", out="key")
    assert rows(cur, "id", "key") == [(1, 3), (2, 3), (2, 3), (3, 3), (4, 3), (5, -1), (6, 3), (7, -1)]
