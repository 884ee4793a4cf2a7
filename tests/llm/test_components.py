import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lamina.llm.components import connected_groups


def union_find(pairs):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            p[find(a)] = find(b)
    groups = {}
    for x in p:
        groups.setdefault(find(x), []).append(x)
    return sorted((x, min(g)) for g in groups.values() for x in g)


def run(spark, pairs):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in pairs], "a string, b string, u string, cnt int")
    return rows(connected_groups(df, F.col("a"), F.col("b")))


def test_chain_star_and_noise(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    rng = random.Random(4)
    rng.shuffle(chain)
    star = [("hub", f"s{i:03}") for i in range(150)]
    noise = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)]
    pairs = chain + star + noise + [(None, "x"), ("x", None), ("y", "y"), ("hub", "s001"), ("s001", "hub")]
    assert run(spark, pairs) == union_find(pairs)


def test_empty_and_only_loops(spark):
    assert run(spark, []) == []
    assert run(spark, [("a", "a"), (None, None)]) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"v{rng.randrange(200):03}", f"v{rng.randrange(200):03}") for _ in range(130)]
    assert run(spark, pairs) == union_find(pairs)
