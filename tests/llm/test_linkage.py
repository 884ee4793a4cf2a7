import random
from datetime import date

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from lamina.llm.linkage import ATTRS, FIRST_GUESS, LabelModel, _meet, candidate_pairs, first_guess, link, variants

DDL = "uid string, given string, family string, dob date, sex string, card string, postal string, phone string, card_digits string, fsa string, phone7 string, votes string"


def word(rng, n):
    return "".join(rng.choice("BDFGKLMNPRSTVZ") + rng.choice("AEIOU") for _ in range(n))


def person(rng, i):
    card = f"{rng.randrange(10**9, 10**10)}"
    phone = f"555{rng.randrange(10**6, 10**7)}"
    postal = f"W{i % 10}A{rng.randrange(10)}B{rng.randrange(10)}"
    return [word(rng, 3), word(rng, 4), date(1950 + i % 50, 1 + i % 12, 1 + i % 28), "FM"[i % 2], card, postal, phone]


def record(uid, p):
    given, family, dob, sex, card, postal, phone = p
    return (uid, given, family, dob, sex, card, postal, phone, card, postal and postal[:3], phone and phone[-7:], "x")


def dirty(rng, p):
    p = list(p)
    for k in rng.sample([3, 4, 5, 6], rng.randrange(0, 3)):
        p[k] = None
    if rng.random() < 0.2:
        p[0] = p[0][:3] + p[0][4:]
    return p


def world(spark, n=250, seed=1):
    rng = random.Random(seed)
    people = [person(rng, i) for i in range(n)]
    left = [record(f"L|{i:04}", dirty(rng, p)) for i, p in enumerate(people)]
    right = [record(f"R|{i:04}", dirty(rng, p)) for i, p in enumerate(people[: n // 2])] + [record(f"R|{5000 + i}", person(rng, 10_007 + 37 * i)) for i in range(100)]
    return spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL), {(f"L|{i:04}", f"R|{i:04}") for i in range(n // 2)}


def test_finds_true_pairs(spark):
    left, right, truth = world(spark)
    got = {(r.uid_a, r.uid_b): r.confidence for r in link(left, right).collect()}
    hit = truth & set(got)
    assert len(hit) >= 0.95 * len(truth) and len(hit) >= 0.95 * len(got)
    assert all(0.5 <= c <= 1 for c in got.values())


def test_all_pairs_of_a_common_key_are_candidates(spark):
    rng = random.Random(2)
    left, right = [], []
    for i in range(300):
        p = person(rng, i)
        p[6] = "5551234567"  # a shared stand-in phone
        left.append(record(f"L|{i}", p))
        right.append(record(f"R|{i}", p))
    lv, rv = (variants(spark.createDataFrame(x, DDL)).select("uid", "vid", *ATTRS) for x in (left, right))
    assert candidate_pairs(lv, rv).count() == 300 * 300


def test_common_key_finds_pairs_that_agree_only_nearly(spark):
    rng = random.Random(5)
    left, right, truth = [], [], set()
    for i in range(150):
        p = person(rng, i)
        p[6] = "5551234567"  # a shared stand-in phone is all that agrees exactly
        q = list(p)
        q[0] = p[0][0] + ("O" if p[0][1] != "O" else "A") + p[0][2:]
        q[1] = p[1][:4] + ("R" if p[1][4] != "R" else "L") + p[1][5:]
        q[2] = p[2].replace(day=p[2].day % 28 + 1)
        q[4] = p[4][:7] + str((int(p[4][7]) + 1) % 10) + p[4][8:]
        q[5] = None
        left.append(record(f"L|{i}", p))
        right.append(record(f"R|{i}", q))
        truth.add((f"L|{i}", f"R|{i}"))
    # pairs of the usual kind, from which the model learns
    more = world(spark)
    left, right = (spark.createDataFrame(x, DDL).union(m.withColumn("uid", F.concat("uid", F.lit("w")))) for x, m in zip((left, right), more[:2], strict=True))
    got = {(r.uid_a, r.uid_b) for r in link(left, right).collect()}
    assert len(truth & got) >= 0.95 * len(truth)


def test_sub_blocks_hold_every_pair_once(spark):
    a, b = (spark.range(n).select(F.col("id").alias("vid"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k")) for n in (90, 150))
    got = _meet(a, b, 7)
    assert got.count() == got.distinct().count() == a.join(b, "k").count()


def test_copies_empty_and_nulls(spark):
    left, right, _ = world(spark, 40)
    assert link(left.limit(0), right).collect() == []
    nothing = spark.createDataFrame([("L|1", *[None] * 11), ("L|1", *[None] * 11)], DDL)
    assert link(nothing, right).collect() == []
    many = left.union(left.withColumn("uid", F.concat("uid", F.lit("copy"))))
    one, two = rows(link(left, right), "uid_a", "uid_b"), rows(link(many, right), "uid_a", "uid_b")
    assert len(two) == 2 * len(one)


def test_label_model_learns_accuracies_and_correlation():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.3
    acc = [0.95, 0.85, 0.8, 0.7]
    cols = []
    for a in acc:
        right = rng.random(len(y)) < a
        cols.append(np.where(right, np.where(y, 1, -1), np.where(y, -1, 1)))
    cols.append(cols[3].copy())  # a copy of the weakest voter
    votes = np.stack(cols, 1)
    votes[rng.random(votes.shape) < 0.1] = 0
    u, n = np.unique(votes, axis=0, return_counts=True)
    p = 1 / (1 + np.exp(-u.sum(1)))
    m = LabelModel().fit(u, n.astype(float), np.stack([p, 1 - p], 1))
    got = m.accuracies()
    assert got[0] > got[3] and abs(got[0] - 0.95) < 0.1
    assert m.parents[0][4] == 3 or m.parents[0][3] == 4
    p = m.posterior(votes)
    assert ((p > 0.5) == y).mean() > 0.9


def test_relatives_are_no_matches():
    """Votes of households: a class of their own keeps pairs that share all but the person apart, however many there are."""
    rng = np.random.default_rng(1)
    names = list(FIRST_GUESS)
    agree = {"match": dict.fromkeys(names, 0.93), "twin": dict.fromkeys(names, 0.95) | dict.fromkeys(("card", "card_typo", "given", "initial"), 0.06), "other": dict.fromkeys(names, 0.08)}
    kinds = rng.choice(list(agree), 6000, p=[0.5, 0.2, 0.3])
    votes = np.array([[1 if rng.random() < agree[k][v] else -1 for v in names] for k in kinds])
    votes[rng.random(votes.shape) < 0.15] = 0
    u, n = np.unique(votes, axis=0, return_counts=True)
    p = LabelModel().fit(u, n.astype(float), first_guess(u, names)).posterior(votes)
    assert ((p >= 0.5) == (kinds == "match")).mean() > 0.98
