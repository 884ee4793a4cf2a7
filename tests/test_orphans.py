import random

import numpy as np
import pyarrow as pa
from conftest import rows
from pyspark.sql import functions as F

from lamina.operators.orphans import SortedKeys, missing_references, orphan_report


def test_matches_brute_force_with_hot_key(spark):
    rng = random.Random(2)
    parents = [(f"k{rng.randrange(300)}", "x") for _ in range(250)] + [(None, "x"), ("k1", "x")]
    known = {p[0] for p in parents}
    refs = [(i, "hot" if rng.random() < 0.4 else "k7" if rng.random() < 0.3 else f"k{rng.randrange(400)}", "y") for i in range(3000)] + [(9000, None, "y")]
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = missing_references(spark.createDataFrame(refs, "id int, key string, _row string"), spark.createDataFrame(parents, "key string, id string"), ref_key=F.col("key"), parent_key=F.col("key"), keep=["id"])
        assert sorted(r.id for r in got.collect()) == sorted(i for i, k, _ in refs if k is not None and k not in known)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_sides(spark):
    r = spark.createDataFrame([(1, "a"), (1, "a")], "id int, key string")
    none = r.limit(0)
    kw = {"ref_key": F.col("key"), "parent_key": F.col("key"), "keep": ["id"]}
    assert rows(missing_references(r, none, **kw), "id") == [(1,), (1,)]
    assert rows(missing_references(none, r, **kw)) == []


def test_report(spark):
    df = spark.createDataFrame([("a", "2024-01-05"), ("a", "2024-01-09"), ("b", "2024-02-01")], "ref_key string, d string").withColumn("d", F.to_date("d"))
    assert rows(orphan_report(df, ref_field="t.c", period=F.col("d"))) == [("t.c", "2024-01", 2, 1), ("t.c", "2024-02", 1, 1)]


def test_number_keys(spark):
    r, p = spark.createDataFrame([(1, 5), (2, 6)], "id int, key long"), spark.createDataFrame([(5,)], "key int")
    assert rows(missing_references(r, p, ref_key=F.col("key"), parent_key=F.col("key"), keep=["id"]), "id") == [(2,)]


def test_equal_hashes_are_told_apart_by_text():
    store = SortedKeys(np.array([1, 5, 5, 5, 9]), pa.array(["a", "b", "c", "d", "e"]))
    assert store.missing(np.array([5, 5, 5, 9, 2, 10]), pa.array(["d", "x", "b", "e", "a", "e"])).tolist() == [False, True, False, False, True, True]
    assert SortedKeys(np.empty(0, np.int64), pa.array([], pa.string())).missing(np.array([1]), pa.array(["a"])).tolist() == [True]


def test_partitions_keep_their_numbers_in_a_union(spark):
    refs = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(600)], "id int, key string")
    parents = spark.createDataFrame([("hot",)] + [(f"k{i}",) for i in range(0, 600, 6)], "key string")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = lambda: missing_references(refs, parents, ref_key=F.col("key"), parent_key=F.col("key"), keep=["id"])
        got = sorted(r.id for r in one().unionByName(one()).unionByName(one()).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted([i for i in range(0, 600, 3) if i % 6] * 3)
