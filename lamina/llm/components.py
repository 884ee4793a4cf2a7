"""Consolidating pairwise matches into groups (problem 5): seed-tree pruning.

Every round, vertices connect their neighbourhood to its minimum; vertices that no one
chose as a minimum drop out and hang below theirs in a propagation forest, and only the
chosen ones, connected among each other, go on. The graph shrinks to nothing in a
logarithmic number of rounds. Then the seed identifiers, the minima of the components, flow
down the forest, last round first. All state lives in pinned tables in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.hot import lookup_join
from lamina.session import pin, pin_counted, ship


def _both_ways(edges: DataFrame) -> DataFrame:
    """(u, v) and (v, u) of every edge, each once, without loops."""
    e = edges.filter(F.col("u") != F.col("v"))
    return e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").distinct()


def connected_groups(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """``record_uid, group_id`` of every record tied to at least one other.

    The group's identifier is its smallest record identifier in binary string order. Pairs
    with a null side and pairs of a record with itself tie nothing; repeats and either order
    of a pair are one; an empty input gives no groups. There is no limit on the rounds: the
    loop ends when no edge is left, and every round removes vertices.
    """
    ship(pairs.sparkSession)
    edges = pairs.select(a.alias("u"), b.alias("v")).filter("u is not null and v is not null")
    graph, n = pin_counted(_both_ways(edges))
    seeds = graph.select("u").distinct()
    forest: list[DataFrame] = []  # per round: child, parent
    while n:
        low = pin(graph.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("cnt")).withColumn("m", F.least("u", "m")))
        # minimum selection: u's neighbours and u itself point at u's minimum
        chosen, total = pin_counted(lookup_join(graph, low, "u", n).select(F.col("v").alias("u"), "m").unionByName(low.select("u", "m")).distinct())
        best = pin(chosen.groupBy("u").agg(F.min("m").alias("p"), F.count("*").alias("cnt"), F.max(F.col("m") == F.col("u")).alias("stays")))
        # pruning: a vertex that is nobody's minimum leaves the graph and hangs below its own
        forest.append(best.filter(~F.col("stays")).select(F.col("u").alias("child"), F.col("p").alias("parent")))
        links = lookup_join(chosen, best.select("u", "p", "cnt"), "u", total).filter(F.col("m") != F.col("p"))
        graph, n = pin_counted(_both_ways(links.select(F.col("p").alias("u"), F.col("m").alias("v"))))
    # seeds flow down, last round first; each round resolves its own tree only, and the rounds after it are ever smaller
    done: list[DataFrame] = []  # child, seed
    for tree in reversed(forest):
        if done:
            known = reduce(DataFrame.unionByName, done).select(F.col("child").alias("parent"), "seed")
            tree = tree.join(known, "parent", "left").select("child", F.coalesce("seed", "parent").alias("seed"))
        else:
            tree = tree.select("child", F.col("parent").alias("seed"))
        done.append(pin(tree) if tree is not forest[0] else tree)
    if not done:
        return seeds.select(F.col("u").alias("record_uid"), F.col("u").alias("group_id"))
    labels = reduce(DataFrame.unionByName, done)
    # who never left is the seed of its group, and every group has somebody who left
    own = labels.select("seed").distinct().select(F.col("seed").alias("record_uid"), F.col("seed").alias("group_id"))
    return labels.select(F.col("child").alias("record_uid"), F.col("seed").alias("group_id")).unionByName(own)
