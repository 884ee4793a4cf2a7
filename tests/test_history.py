import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lamina.operators.history import snapshot, version_history

DDL = "e string, t timestamp, p string, x timestamp, entity_name int, extra string"
T0 = datetime(2024, 1, 1)


def at(n):
    return T0 + timedelta(seconds=n)


def brute(rows, high=datetime(9999, 12, 31)):
    out = []
    for e in {r[0] for r in rows if r[0] is not None}:
        state = {}
        for r in sorted((r for r in rows if r[0] == e and r[1] is not None), key=lambda r: (r[1], r[2] or "")):
            ends = r[3] or state.get(r[1], (None, None))[1]
            state[r[1]] = (r[2] or "", r[3] if r[3] else None)
        runs = []
        for t in sorted(state):
            p, ends = state[t]
            if runs and runs[-1][1] == p:
                runs[-1][2] = ends or runs[-1][2]
            else:
                runs.append([t, p, ends])
        for a, b in zip(runs, [*runs[1:], None]):
            to = min(x for x in (b[0] if b else high, a[2] or high))
            out.append((e, a[1], a[0], to))
    return sorted(out)


def run(spark, data, partitions=None):
    df = spark.createDataFrame(data, DDL)
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        v = version_history([snapshot(df, "n", F.col("e"), F.col("t"), F.col("p"), F.col("x"))])
        return sorted((r.entity_id, r.payload, r.valid_from, r.valid_to) for r in v.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_versions_close_on_change_only(spark):
    data = [("a", at(1), "x", None, 1, "k"), ("a", at(2), "x", None, 1, "k"), ("a", at(3), "y", None, 1, "k"), ("a", at(3), "y", None, 1, "k"), ("b", at(5), "z", at(9), 1, "k")]
    high = datetime(9999, 12, 31)
    assert run(spark, data) == [("a", "x", at(1), at(3)), ("a", "y", at(3), high), ("b", "z", at(5), at(9))]


def test_nulls_empty_and_ties(spark):
    assert run(spark, []) == []
    data = [(None, at(1), "x", None, 1, None), ("a", None, "x", None, 1, None), ("a", at(1), None, None, None, None), ("a", at(1), "b", None, 1, None)]
    assert run(spark, data) == [("a", "b", at(1), datetime(9999, 12, 31))]


def test_hot_entity_over_many_partitions_matches_brute_force(spark):
    rng = random.Random(3)
    data = []
    for _ in range(1500):
        e = "hot" if rng.random() < 0.6 else f"e{rng.randrange(40)}"
        data.append((e, at(rng.randrange(700)), rng.choice("ab" if rng.random() < 0.3 else "a"), at(rng.randrange(700, 900)) if rng.random() < 0.02 else None, 0, None))
    # one end per instant, so that ties are plain
    seen, clean = set(), []
    for r in data:
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            clean.append(r)
    assert run(spark, clean, 13) == brute(clean)


def test_a_version_spanning_whole_partitions(spark):
    data = [("hot", at(i), "a", None, 0, None) for i in range(400)] + [("hot", at(400), "b", None, 0, None)]
    assert run(spark, data, 9) == [("hot", "a", at(0), at(400)), ("hot", "b", at(400), datetime(9999, 12, 31))]


def test_merge_of_runs_is_a_sort():
    import pyarrow as pa

    from lamina.operators.history import _KEY, _key, merge_runs

    rng = random.Random(7)
    runs, flat = [], []
    for src in range(4):
        rows = sorted((("n", f"e{rng.randrange(6)}", rng.randrange(9), src % 2, rng.choice("ab"), rng.choice([-1, 5])) for _ in range(rng.randrange(60))))
        flat += rows
        for k in range(0, len(rows), 7):
            part = rows[k : k + 7]
            b = pa.RecordBatch.from_pylist([dict(zip(_KEY, (*r[:5], None if r[5] < 0 else r[5]), strict=True)) for r in part])
            runs.append((part[0], src, b))
    runs.sort(key=lambda x: (x[0], x[1]))
    got = [_key(b, i) for b in merge_runs(iter(runs)) for i in range(b.num_rows)]
    assert got == sorted(flat)
    assert list(merge_runs(iter([]))) == []


def test_many_snapshots_of_many_entities(spark):
    """Snapshots of one table taken at several times, with hot and absent entities, against brute force."""
    rng = random.Random(11)
    shots, every = [], []
    for k in range(5):
        data = []
        for e in ["hot"] * 200 + [f"e{i}" for i in range(30) if rng.random() < 0.8]:
            data.append((e, at(k * 1000 + rng.randrange(900)), rng.choice("abc"), None, 0, None))
        data = list({(r[0], r[1]): r for r in data}.values())
        every += data
        shots.append(snapshot(spark.createDataFrame(data, DDL), "n", F.col("e"), F.col("t"), F.col("p"), F.col("x")))
    spark.conf.set("spark.sql.shuffle.partitions", 6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.entity_id, r.payload, r.valid_from, r.valid_to) for r in version_history(shots).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(every)


def test_histories_in_a_union(spark):
    data = [("hot", at(i), "ab"[i // 7 % 2], None, 0, None) for i in range(300)]
    df = spark.createDataFrame(data, DDL)
    spark.conf.set("spark.sql.shuffle.partitions", 6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = lambda: version_history([snapshot(df, "n", F.col("e"), F.col("t"), F.col("p"), F.col("x"))])
        got = sorted((r.entity_id, r.payload, r.valid_from, r.valid_to) for r in one().unionByName(one()).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted(brute(data) * 2)
