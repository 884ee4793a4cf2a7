"""Matching entities across sources without keys (problem 3): label-model linkage.

Heuristic matching functions vote match (1), no match (-1) or abstain (0) on every candidate pair.
A generative model of the votes, fitted without any labels, learns how often each function is
right and, per class, a dependency tree of all functions (Chow-Liu), so that correlated
votes are not counted twice. Pairs of different persons are of several kinds, each a class of its own: relatives
and strangers, born on one day or not; votes that go together because of the kind are so no
evidence of a match. The posterior of the class of matches is the confidence.

Records are first reduced to distinct attribute variants, so that copies are compared once.
Candidates share a block key; all pairs of a key are compared, however common it is (a stand-in
value, a big household), those of a large block in sub-blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import pin, ship

ATTRS = ("given", "family", "dob", "sex", "card", "postal", "phone", "card_digits", "fsa", "phone7")


def variants(records: DataFrame) -> DataFrame:
    """``records`` with ``vid``, an identifier of the combination of attribute values."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ATTRS]
    return records.withColumn("vid", F.unhex(F.md5(F.concat_ws("\x1f", *parts))))


def _sim(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def _letters(a: Column) -> Column:
    return F.array_sort(F.split(a, ""))


def _close(a: Column, b: Column) -> Column:
    """Similarity of two names; letters in another order after the same first one are a slip of the fingers."""
    slip = (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (_letters(a) == _letters(b))
    return F.when(slip, 0.9).otherwise(_sim(a, b))


def _known(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def voters(a: str = "a", b: str = "b") -> dict[str, Column]:
    """The matching functions over structs ``a`` and ``b`` of variant attributes."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    same = lambda c: _vote(x(c) == y(c), _known(x(c), y(c)))
    fam_a, fam_b, giv_a, giv_b = x("family"), y("family"), x("given"), y("given")
    part = F.arrays_overlap(F.split(fam_a, " "), F.split(fam_b, " "))
    fam = F.greatest(_close(fam_a, fam_b), F.when(part, 1.0).otherwise(0.0))
    first_a, first_b = F.substring_index(giv_a, " ", 1), F.substring_index(giv_b, " ", 1)
    giv = _close(first_a, first_b)
    stem = lambda c: F.regexp_replace(c, "(IE|Y|I|O|EE)$", "")
    pet = lambda c, d: (F.length(stem(c)) >= 2) & (stem(c) != c) & d.startswith(stem(c))
    short = first_a.startswith(first_b) | first_b.startswith(first_a) | pet(first_a, first_b) | pet(first_b, first_a)
    da, db = x("dob"), y("dob")
    text = lambda d: F.date_format(d, "yyyyMMdd")
    slipped = F.levenshtein(text(da), text(db)) <= 2
    hits = sum(F.when(f(da) == f(db), 1).otherwise(0) for f in (F.year, F.month, F.dayofmonth))
    swapped = (F.month(da) == F.dayofmonth(db)) & (F.dayofmonth(da) == F.month(db)) & (F.year(da) == F.year(db))
    digits_a, digits_b = x("card_digits"), y("card_digits")
    typo = (F.least(F.length(digits_a), F.length(digits_b)) >= 8) & (F.levenshtein(digits_a, digits_b) <= 2)
    among = lambda c, d: F.coalesce(F.exists(F.split(d, " "), lambda w: (_sim(w, c) >= 0.75) & (F.length(c) > 2)), F.lit(False))
    crossed = (among(first_a, fam_b) | among(first_b, fam_a)) & (giv < 0.7) & ~short
    no = F.lit(False)
    one_card = F.coalesce(x("card") == y("card"), no)
    return {
        "card": same("card"),
        "card_typo": _vote(typo & ~one_card, no),
        "dob": same("dob"),
        "dob_near": F.when(F.coalesce(da == db, F.lit(True)), 0).when(swapped | slipped | (hits == 2), 1).otherwise(-1),
        "family": F.when(crossed, 0).otherwise(_vote(fam >= 0.75, _known(fam_a, fam_b))),
        "given": F.when(giv >= 0.7, 1).when(F.coalesce(short | crossed, F.lit(True)), 0).otherwise(-1),
        "initial": F.when(crossed, 0).otherwise(_vote(F.substring(giv_a, 1, 1) == F.substring(giv_b, 1, 1), _known(giv_a, giv_b))),
        "crossed": _vote(crossed, no),
        "phone": _vote((x("phone") == y("phone")) | (x("phone7") == y("phone7")), _known(x("phone7"), y("phone7"))),
        "postal": same("postal"),
        "area": same("fsa"),
        "sex": same("sex"),
    }


def _block_keys() -> list[Column]:
    """Keys under which a variant meets others, null where a part is missing."""
    fam, giv, dob = F.col("family"), F.col("given"), F.col("dob")
    k = lambda n, *p: F.concat(F.lit(n + ":"), *[F.concat(c.cast("string"), F.lit("|")) for c in p])
    return [
        k("card", F.col("card")),
        k("phone", F.col("phone7")),
        k("day, family sound", dob, F.soundex(F.substring_index(fam, " ", -1))),
        k("day, given", dob, F.substring(giv, 1, 2)),
        k("day, area", dob, F.col("fsa")),
        k("names, area", F.substring(fam, 1, 4), F.substring(giv, 1, 2), F.col("fsa")),
        k("given, postal", F.substring(giv, 1, 3), F.col("postal")),
        k("card end, initial", F.when(F.length("card_digits") >= 9, F.right("card_digits", F.lit(5))), F.substring(giv, 1, 1)),
        k("names in any order, year", F.least(fam, giv), F.greatest(fam, giv), F.year(dob)),
    ]


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``va, vb`` of the distinct variants of either side that share a block key, each pair once.

    Only variant ids and 64-bit key hashes move; keys of equal hash merely add a candidate. Every
    pair of a key counts, however common it is.
    """
    keys = F.transform(F.array_compact(F.array(*_block_keys())), lambda k: F.xxhash64(k))
    return _meet(*[df.dropDuplicates(["vid"]).select("vid", F.explode(keys).alias("k")) for df in (left, right)]).distinct()


#: Rows of either side that a sub-block of a large block holds on average.
BLOCK_ROWS = 2_000


def _meet(a: DataFrame, b: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``va, vb`` of all rows of equal ``k``; a large block is cut into sub-blocks, each part of ``a`` with each of ``b``."""
    parts = lambda c: F.ceil(F.col(c) / block_rows)
    asked = a.groupBy("k").agg(F.count("*").alias("na")).join(b.groupBy("k").agg(F.count("*").alias("nb")), "k")
    big = pin(asked.filter(F.col("na") * F.col("nb") > block_rows**2).select("k", parts("na").alias("pa"), parts("nb").alias("pb")))
    a, b = a.withColumnRenamed("vid", "va"), b.withColumnRenamed("vid", "vb")
    if big.isEmpty():
        return a.join(b, "k").select("va", "vb")
    rest = [df.join(big.select("k"), "k", "left_anti") for df in (a, b)]
    part = lambda v, n, i: F.pmod(F.xxhash64(v), F.col(n)).alias(i)
    each = lambda n, i: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(i)
    ab = a.join(big, "k").select("k", "va", part("va", "pa", "i"), each("pb", "j"))
    ba = b.join(big, "k").select("k", "vb", each("pa", "i"), part("vb", "pb", "j"))
    return rest[0].join(rest[1], "k").select("va", "vb").unionByName(ab.join(ba, ["k", "i", "j"]).select("va", "vb"))


class LabelModel:
    """Generative model of vote vectors: a class of matches and several kinds of others, each with a dependency tree.

    ``fit`` runs expectation maximisation over the distinct vote vectors and their counts.
    P(votes | class) is a product over the tree: each voter depends on its parent's vote. Nothing but the first
    guess is given; it only settles which class is which.
    """

    def __init__(self, rounds: int = 80, smooth: float = 0.1):
        self.rounds, self.smooth = rounds, smooth

    @staticmethod
    def _tables(onehot: np.ndarray, w: np.ndarray) -> np.ndarray:
        m = onehot.shape[1]
        flat = onehot.reshape(len(onehot), m * 3)
        joint = flat.T @ (flat * w[:, None])
        return joint.reshape(m, 3, m, 3).transpose(0, 2, 1, 3)  # voter, voter, vote, vote

    @staticmethod
    def _tree(joint: np.ndarray) -> list[int]:
        """Parents of a maximum spanning tree over mutual information; -1 for the root."""
        m = len(joint)
        p = joint + 1e-9
        p = p / p.sum((2, 3), keepdims=True)
        px, py = p.sum(3, keepdims=True), p.sum(2, keepdims=True)
        mi = (p * np.log(p / (px * py))).sum((2, 3))
        parent, best, frm = [-1] * m, mi[0].copy(), np.zeros(m, int)
        inside = {0}
        while len(inside) < m:
            j = int(np.argmax(np.where(np.isin(np.arange(m), list(inside)), -np.inf, best)))
            parent[j] = int(frm[j])
            inside.add(j)
            better = mi[j] > best
            best = np.where(better, mi[j], best)
            frm = np.where(better, j, frm)
        return parent

    def _log(self, votes: np.ndarray, joint: np.ndarray, parent: list[int]) -> np.ndarray:
        out = np.zeros(len(votes))
        for j, q in enumerate(parent):
            if q < 0:
                t = joint[j, j].diagonal() + self.smooth
                out += np.log(t / t.sum())[votes[:, j]]
            else:
                t = joint[q, j] + self.smooth
                out += np.log(t / t.sum(1, keepdims=True))[votes[:, q], votes[:, j]]
        return out

    def fit(self, votes: np.ndarray, counts: np.ndarray, guess: np.ndarray) -> LabelModel:
        """``votes`` in {-1, 0, 1}, one row per distinct vector; ``guess`` has a first share per row and class, matches first."""
        onehot = np.eye(3)[votes.astype(int) + 1]
        p = guess
        for _ in range(self.rounds):
            self.joint = [self._tables(onehot, counts * p[:, k]) for k in range(p.shape[1])]
            self.parents = [self._tree(j) for j in self.joint]
            self.prior = np.clip((counts[:, None] * p).sum(0) / counts.sum(), 1e-6, 1)
            new = self.classes(votes)
            if np.abs(new - p).max() < 1e-4:
                break
            p = new
        return self

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """Posterior share of every class."""
        v = votes.astype(int) + 1
        z = np.stack([np.log(p) + self._log(v, j, t) for p, j, t in zip(self.prior, self.joint, self.parents, strict=True)], 1)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Posterior of a match."""
        return self.classes(votes)[:, 0]

    def accuracies(self) -> list[float]:
        """Per voter: how often it is right when it does not abstain."""
        out = []
        for j in range(len(self.parents[0])):
            y = self.joint[0][j, j].diagonal()
            n = sum(t[j, j].diagonal() for t in self.joint[1:])
            out.append(float((y[2] + n[0]) / max(1e-9, y[0] + y[2] + n[0] + n[2])))
        return out


#: Strength with which each voter enters the first guess; the model then learns its own.
FIRST_GUESS = {"card": 4, "card_typo": 3, "dob": 2.5, "dob_near": 1, "family": 1.5, "given": 1.5, "initial": 0.5, "crossed": 4, "phone": 1, "postal": 1, "area": 0.3, "sex": 0.5}
#: Posterior from which a pair counts as a match.
THRESHOLD = 0.5


def first_guess(votes: np.ndarray, names: list[str]) -> np.ndarray:
    """Shares of matches and of the kinds of others: relatives of one day (twins), relatives, strangers of one day, strangers."""
    at = {k: votes[:, i] for i, k in enumerate(names)}
    p = 1 / (1 + np.exp(-np.clip(votes @ np.array([FIRST_GUESS[k] for k in names], dtype=float), -30, 30)))
    related, one_day = (at["family"] == 1) & (at["given"] == -1), at["dob"] == 1
    kind = np.stack([related & one_day, related & ~one_day, ~related & one_day, ~related & ~one_day], 1) * 0.85 + 0.05
    return np.concatenate([p[:, None], (1 - p)[:, None] * kind / kind.sum(1, keepdims=True)], 1)


def link(left: DataFrame, right: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``uid_a, uid_b, confidence`` of record pairs whose posterior is at least ``threshold``.

    ``left`` and ``right`` need ``uid`` and the attribute columns of :mod:`people`; other
    columns do not matter. Null attributes abstain. A record with several rows takes part
    with each of its variants; the best pair of variants counts. Empty sides give no pairs.
    """
    ship(left.sparkSession)
    spark = left.sparkSession
    lv, rv = (pin(variants(df).select("uid", "vid", *ATTRS)) for df in (left, right))
    funcs = voters()
    code = sum((c + 1) * F.lit(3**i).cast("long") for i, c in enumerate(funcs.values()))
    side = lambda df, v, s: df.dropDuplicates(["vid"]).select(F.col("vid").alias(v), F.struct(*ATTRS).alias(s))
    pairs = candidate_pairs(lv, rv).join(side(lv, "va", "a"), "va").join(side(rv, "vb", "b"), "vb")
    pairs = pin(pairs.select("va", "vb", code.alias("votes")))
    seen = pairs.groupBy("votes").agg(F.count("*").alias("n")).collect()  # distinct vote vectors, not pairs
    schema = "votes long, confidence double"
    if seen:
        codes, counts = np.array([r["votes"] for r in seen], dtype=np.int64), np.array([r["n"] for r in seen], dtype=float)
        m = len(funcs)
        votes = (codes[:, None] // 3 ** np.arange(m)[None, :]) % 3 - 1
        model = LabelModel().fit(votes, counts, first_guess(votes, list(funcs)))
        post = model.posterior(votes)
        scores = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post, strict=True) if p >= threshold], schema)
    else:
        scores = spark.createDataFrame([], schema)
    # at most 3 ** 12 rows of 16 bytes
    good = pairs.join(F.broadcast(scores), "votes").select("va", "vb", "confidence")
    la = lv.select(F.col("vid").alias("va"), F.col("uid").alias("uid_a")).distinct()
    rb = rv.select(F.col("vid").alias("vb"), F.col("uid").alias("uid_b")).distinct()
    return good.join(la, "va").join(rb, "vb").groupBy("uid_a", "uid_b").agg(F.max("confidence").alias("confidence"))
