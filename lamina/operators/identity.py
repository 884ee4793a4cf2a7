"""Master person index: normalise, block, score, decide, cluster, assign stable identifiers, evaluate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.scalar import age_band, name_sketch, names_alike, postal_area, record_uid, token_of
from lamina.operators.hot import lookup_join
from lamina.session import pin, written, written_counted

#: the common columns of every source
CONTRACT = ("record_uid", "source_system", "source_id", "given", "family", "birth_date", "sex", "card", "postal", "phone", "updated_ts")
#: score from which a pair is linked, and from which it goes to review (fixed values)
LINK_AT, REVIEW_AT = 14.0, 8.0
#: blocks with more records are reported (fixed value)
REPORT_FROM = 200
#: records of a block that one tile of its pairs takes from either side, on average; each record is in as many tiles as its block has such parts
TILE = 8_000
#: prefix of the columns that are made of a field before records meet
SKETCH = "sketch_of_"


def normalize(df: DataFrame, system: str, columns: dict[str, str], fixes: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """A source in the common contract: ``columns`` maps contract names to its own; missing ones are null."""
    fixes = fixes or {}
    out = [record_uid(system, F.col(columns["source_id"])).alias("record_uid"), F.lit(system).alias("source_system")]
    for c in CONTRACT[2:]:
        v = F.col(columns[c]) if c in columns else F.lit(None).cast("string")
        out.append((fixes[c](v) if c in fixes else v).alias(c))
    return df.select(*out)


def _keys_of(keys: dict[str, list[Column]]) -> Column:
    """The blocks of a record, as an array."""
    parts = []
    for name, cols in keys.items():
        whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
        parts.append(F.when(whole, F.concat_ws("|", F.lit(name), *[c.cast("string") for c in cols])))
    return F.array_compact(F.array(*parts))


def blocks(df: DataFrame, keys: dict[str, list[Column]], uid: str = "record_uid") -> DataFrame:
    """``block, record_uid`` of records that have every part of a key; parts are never silently missing."""
    return df.select(F.col(uid).alias("record_uid"), F.explode(_keys_of(keys)).alias("block")).distinct()


def block_sizes(b: DataFrame) -> DataFrame:
    return b.groupBy("block").agg(F.count("*").alias("records"))


def oversized(b: DataFrame, most: int = REPORT_FROM) -> DataFrame:
    """Blocks worth a look, because their keys are common; their records are paired like all others."""
    return block_sizes(b).filter(F.col("records") > most)


def _met(own: DataFrame, tile: int) -> DataFrame:
    """Every pair that shares a block, once, with ``uid_a < uid_b`` and the attributes as ``a_`` and ``b_`` columns.

    ``own`` has ``record_uid``, its sorted blocks as ``own``, and the attributes. A large block is cut into tiles: its
    records fall into parts by a hash, and every two parts meet in one tile, so that no task gets a whole block and
    no pair is lost. A pair comes from the first block it shares: records bring their earlier blocks along, so that
    pairs need no comparison among each other and never move. Both sides of a tile read the same shuffled rows.
    Sketches of the attributes are made in the tile, so that they do not move either.
    """
    attributes = [c for c in own.columns if c not in ("record_uid", "own")]
    sketches = {f"{SKETCH}{c.field}": c.sketch[1](F.col(c.field)) for c in COMPARATORS if c.sketch is not None and (c.field, c.sketch[0]) in own.dtypes}
    # at most one block in so many rows, so it is always small
    large = block_sizes(own.select(F.explode("own").alias("block"))).filter(F.col("records") > tile).select("block", F.ceil(F.col("records") / tile).cast("int").alias("_n"))
    part = own.filter("record_uid is not null").select("record_uid", *attributes, "own", F.posexplode("own").alias("_k", "block")).join(F.broadcast(large), "block", "left")
    part = part.select("record_uid", *attributes, "block", F.slice("own", F.lit(1), F.col("_k")).alias("_earlier"), F.coalesce("_n", F.lit(1)).alias("_n")).withColumn("_p", F.pmod(F.xxhash64("record_uid"), F.col("_n")).cast("int"))
    tiles = part.withColumn("_q", F.explode(F.expr("sequence(0, _n - 1)"))).select("record_uid", *attributes, "block", "_earlier", "_p", F.least("_p", "_q").alias("i"), F.greatest("_p", "_q").alias("j")).repartition("block", "i", "j")
    # the partition number keeps the tests above the shuffle, which is the same for both sides and hence made once
    side = lambda s, at: tiles.filter(F.col("_p") == F.col(at) + 0 * F.spark_partition_id()).select("block", "i", "j", *[F.col(c).alias(f"_{s}_{c}") for c in ("record_uid", "_earlier", *attributes)], *[v.alias(f"_{s}_{c}") for c, v in sketches.items()])
    x, y = F.col("_x_record_uid"), F.col("_y_record_uid")
    met = side("x", "i").join(side("y", "j"), ["block", "i", "j"]).filter("i < j or _x_record_uid < _y_record_uid").filter("size(_x__earlier) = 0 or size(_y__earlier) = 0 or case when size(_x__earlier) = 1 and size(_y__earlier) = 1 then _x__earlier[0] <> _y__earlier[0] else not arrays_overlap(_x__earlier, _y__earlier) end")
    sides = [F.when(x < y, F.col(f"_{one}_{c}")).otherwise(F.col(f"_{other}_{c}")).alias(f"{s}_{c}") for s, one, other in (("a", "x", "y"), ("b", "y", "x")) for c in (*attributes, *sketches)]
    return met.select(F.least(x, y).alias("uid_a"), F.greatest(x, y).alias("uid_b"), *sides)


def _own(b: DataFrame) -> DataFrame:
    return b.filter("record_uid is not null").groupBy("record_uid").agg(F.sort_array(F.collect_set("block")).alias("own"))


def block_pairs(b: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct ``uid_a < uid_b`` that share a block, however large it is; see :func:`paired`."""
    return _met(_own(b), tile)


def paired(b: DataFrame, people: DataFrame, tile: int = TILE, uid: str = "record_uid") -> DataFrame:
    """:func:`block_pairs` :func:`with_sides`: attributes travel with the records, of which there are few, not with the pairs."""
    return _met(_own(b).join(people.withColumnRenamed(uid, "record_uid"), "record_uid"), tile)


def _gathered(people: DataFrame, keys: dict[str, list[Column]], attributes: list[str]) -> DataFrame:
    """``record_uid, own`` and attributes: the records go once to where all rows of an identifier are; each has the blocks of all of them."""
    rows = people.filter("record_uid is not null").select("record_uid", _keys_of(keys).alias("own"), *attributes).repartition("record_uid")
    whole = F.sort_array(F.array_distinct(F.flatten(F.collect_list("own")))).alias("own")
    if not attributes:
        return rows.groupBy("record_uid").agg(whole)
    return rows.groupBy("record_uid").agg(whole, F.collect_list(F.struct(*attributes)).alias("_r")).select("record_uid", "own", F.explode("_r").alias("_r")).select("record_uid", "own", "_r.*")


def pairs_by(people: DataFrame, keys: dict[str, list[Column]], tile: int = TILE) -> DataFrame:
    """:func:`block_pairs` of :func:`blocks`, without a table of blocks: the records of ``people`` carry theirs."""
    return _met(_gathered(people, keys, []), tile)


def paired_by(people: DataFrame, keys: dict[str, list[Column]], tile: int = TILE, at_least: float | None = None) -> DataFrame:
    """:func:`paired` of :func:`blocks`, without a table of blocks: the records of ``people`` carry theirs.

    With ``at_least``, pairs whose score cannot reach it may be missing: where a field must agree for that, blocks
    are split by its values, and only pairs that lack it on either side come from the whole blocks.
    """
    own = _gathered(people, keys, [c for c in people.columns if c != "record_uid"])
    kinds = dict(people.dtypes)
    must = [] if at_least is None else [c.field for c in COMPARATORS if kinds[c.field] in ("string", "date", "int", "bigint") and c.must_agree(COMPARATORS, at_least)]
    if not must:
        return _met(own, tile)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in must])
    # the length keeps block and values apart
    value = F.concat_ws("|", *[F.concat_ws(":", F.length(F.col(c).cast("string")), F.col(c).cast("string")) for c in must])
    agreeing = _met(own.filter(known).withColumn("own", F.transform("own", lambda o: F.concat_ws("|", value, o))), tile)
    if people.filter(~known).isEmpty():
        return agreeing
    lacking = reduce(lambda a, b: a | b, [F.col(f"{s}_{c}").isNull() for c in must for s in "ab"])
    return agreeing.unionByName(_met(own, tile).filter(lacking))


def with_sides(pairs: DataFrame, people: DataFrame, uid: str = "record_uid") -> DataFrame:
    """Pairs with the attributes of either side as ``a_`` and ``b_`` columns."""
    for s in "ab":
        side = people.select(F.col(uid).alias(f"uid_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in people.columns if c != uid])
        pairs = pairs.join(side, f"uid_{s}")
    return pairs


@dataclass(frozen=True)
class Comparator:
    """Weighted evidence: the first level whose test holds counts; a missing side counts nothing."""

    field: str
    levels: tuple[tuple[Callable[[Column, Column], Column], float], ...]
    otherwise: float = 0.0
    #: comes last where a score is asked for from some height only
    costly: bool = False
    #: (type of the field, what is made of it before records meet); the tests then get those of both sides as a third argument, or None
    sketch: tuple[str, Callable[[Column], Column]] | None = None

    def most(self) -> float:
        return max(0.0, float(self.otherwise), *[float(p) for _, p in self.levels])

    def must_agree(self, among: tuple[Comparator, ...], at_least: float) -> bool:
        """Whether a pair that has the field on both sides, but not equal, stays below ``at_least`` whatever else agrees."""
        if not self.levels or self.levels[0][0] is not _same:
            return False
        rest = sum(c.most() for c in among if c is not self)
        return rest + max(float(self.otherwise), *[float(p) for _, p in self.levels[1:]], -np.inf) < at_least - 1e-6

    def points(self, sketched: bool = False) -> Column:
        a, b = F.col(f"a_{self.field}"), F.col(f"b_{self.field}")
        more = () if self.sketch is None else ((F.col(f"a_{SKETCH}{self.field}"), F.col(f"b_{SKETCH}{self.field}")) if sketched else None,)
        out = F.when(a.isNull() | b.isNull(), 0.0)
        for test, p in self.levels:
            out = out.when(test(a, b, *more), float(p))
        return out.otherwise(float(self.otherwise))


def _same(a: Column, b: Column, *_) -> Column:
    return a == b


def _exchanged(d: Column) -> Column:
    """The date with day and month exchanged, null if there is none."""
    return F.when(F.dayofmonth(d) <= 12, F.make_date(F.year(d), F.dayofmonth(d), F.month(d)))


def _swapped(a: Column, b: Column, exchanged: tuple[Column, Column] | None = None) -> Column:
    if exchanged is not None:
        return a == exchanged[1]
    return (F.year(a) == F.year(b)) & (F.month(a) == F.dayofmonth(b)) & (F.dayofmonth(a) == F.month(b))


#: agreement and disagreement weights (fixed values)
COMPARATORS = (
    Comparator("card", ((_same, 12),), -6),
    Comparator("birth_date", ((_same, 6), (_swapped, 5), (lambda a, b, *_: F.abs(F.datediff(a, b)) <= 31, 2)), -5, sketch=("date", _exchanged)),
    Comparator("family", ((lambda a, b, s: names_alike(a, b, 0.90, s), 4),), -3, costly=True, sketch=("string", lambda v: name_sketch(v, 0.90))),
    Comparator("given", ((lambda a, b, s: names_alike(a, b, 0.88, s), 3),), -2, costly=True, sketch=("string", lambda v: name_sketch(v, 0.88))),
    Comparator("sex", ((lambda a, b: (a == "UNKNOWN") | (b == "UNKNOWN"), 0), (_same, 1)), -3),
    Comparator("postal", ((_same, 3), (lambda a, b: F.substring(a, 1, 3) == F.substring(b, 1, 3), 1)), -1),
    Comparator("phone", ((_same, 2.5),), -0.5),
)


def score(sides: DataFrame, comparators: tuple[Comparator, ...] = COMPARATORS, out: str = "match_score", at_least: float | None = None) -> DataFrame:
    """Sum of all points; with ``at_least``, only pairs that reach it: costly comparisons are made where they can still matter."""
    total = lambda points: reduce(lambda a, b: a + b, points)
    made_before = [f"{s}_{SKETCH}{c.field}" for c in comparators for s in "ab" if c.sketch is not None]
    points = lambda c: c.points(f"a_{SKETCH}{c.field}" in sides.columns)
    if at_least is None:
        return sides.withColumn(out, total([points(c) for c in comparators])).drop(*made_before)
    # the partition number keeps the tests out of the join, whose loop they would make too long to compile, and apart from each other
    apart = 0.0 * F.spark_partition_id()
    known: dict[int, Column] = {}
    near = sides
    steps = [[c for c in comparators if not c.costly], *[[c] for c in sorted((c for c in comparators if c.costly), key=lambda c: c.otherwise - c.most())]]
    for step in [x for x in steps if x]:
        made = {comparators.index(c): points(c) + apart for c in step}
        near = near.withColumns({f"_s{i}": p for i, p in made.items()})
        known |= {i: F.col(f"_s{i}") for i in made}
        near = near.filter(total([known.get(i, F.lit(c.most())) for i, c in enumerate(comparators)]) >= at_least - 1e-6)
    return near.withColumn(out, total([known[i] for i in range(len(comparators))])).filter(F.col(out) >= at_least).drop(*[f"_s{i}" for i in known], *made_before)


def decide(scored: DataFrame, overrides: DataFrame | Column | None = None, link_at: float = LINK_AT, review_at: float = REVIEW_AT) -> DataFrame:
    """``decision``: an override, else AUTO_LINK, REVIEW or DISTINCT by score. Either order of an override pair counts; NO_MATCH wins.

    Overrides that follow from the pair itself may be a column (MATCH, NO_MATCH or null) and need no join.
    """
    s = F.col("match_score")
    auto = F.when(s >= link_at, "AUTO_LINK").when(s >= review_at, "REVIEW").otherwise("DISTINCT")
    if overrides is None:
        return scored.withColumn("decision", auto)
    ruled = lambda o: F.when(o == "MATCH", "AUTO_LINK").when(o == "NO_MATCH", "DISTINCT").otherwise(auto)
    if isinstance(overrides, Column):
        return scored.withColumn("decision", ruled(overrides))
    o = overrides.filter(F.col("decision").isin("MATCH", "NO_MATCH")).groupBy(F.least("uid_a", "uid_b").alias("uid_a"), F.greatest("uid_a", "uid_b").alias("uid_b")).agg(F.max("decision").alias("_o"))
    return scored.join(o, ["uid_a", "uid_b"], "left").withColumn("decision", ruled(F.col("_o"))).drop("_o")


def review_queue(decided: DataFrame) -> DataFrame:
    return decided.filter("decision = 'REVIEW'").select("uid_a", "uid_b", "match_score")


#: ties a task holds before it thins them again
HELD = 500_000


def _thin(ties: pa.Table) -> pa.Table:
    """Ties ``u, v, s`` without those that close a circle: each member tied to one of its group, with the group's smallest ``s``."""
    n = ties.num_rows
    names = pa.chunked_array(ties["u"].chunks + ties["v"].chunks, ties["u"].type).combine_chunks().dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    u, v, root = code[:n], code[n:], np.arange(len(names.dictionary))
    while (root[u] != root[v]).any():
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while (root[root] != root).any():
            root = root[root]
    weakest = np.full(len(root), np.inf)
    np.minimum.at(weakest, root[u], ties["s"].to_numpy())
    member = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"u": names.dictionary.take(pa.array(root[member])), "v": names.dictionary.take(pa.array(member)), "s": pa.array(weakest[root[member]])})


def spanning(links: DataFrame, score: str = "match_score") -> DataFrame:
    """Links ``uid_a, uid_b, score`` that tie the same records together, far fewer: each task leaves out those that close a circle.

    The smallest score of a person's links stays what it was; the other scores do not.
    """

    def thin(batches):
        held, rows = [], 0
        for b in batches:
            # without the batch's notes on nulls, which a thinned table has not
            held.append(pa.RecordBatch.from_arrays(b.columns, names=["u", "v", "s"]))
            rows += b.num_rows
            if rows > HELD:
                # what is left is at most one tie per record of the task
                held = _thin(pa.Table.from_batches(held)).to_batches()
                rows = min(sum(b.num_rows for b in held), HELD // 2)
        if held:
            yield from _thin(pa.Table.from_batches(held)).to_batches()

    ties = links.select(F.col("uid_a").alias("u"), F.col("uid_b").alias("v"), F.col(score).cast("double").alias("s")).filter("u is not null and v is not null and u <> v and s is not null")
    kind = ties.schema["u"].dataType.simpleString()
    return ties.mapInArrow(thin, f"u {kind}, v {kind}, s double").select(F.col("u").alias("uid_a"), F.col("v").alias("uid_b"), F.col("s").alias(score))


def components(vertices: DataFrame, edges: DataFrame, uid: str = "record_uid") -> DataFrame:
    """``record_uid, component``: the smallest identifier of each connected component.

    Every round, each vertex chooses the neighbour (or itself) whose hash is smallest, and the edges
    are contracted to the chosen ones, so that the graph shrinks by a constant factor whatever its shape; loops
    and repeats drop out. The trees of those that left are then resolved from the last to the first. Runs until no edge
    is left. Edges between unknown vertices count; a null side ties nothing. Edges that close a circle
    within the task that made them never leave it.
    """
    e = spanning(edges.select("uid_a", "uid_b", F.lit(0.0).alias("match_score"))).select(F.col("uid_a").alias("u"), F.col("uid_b").alias("v"))
    graph, n = written_counted(_both_ways(e))
    trees: list[DataFrame] = []
    while n:
        mark = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("r"))
        low = graph.groupBy("u").agg(F.min(mark("v")).alias("m"), F.count("*").alias("cnt")).select("u", F.least("m", mark("u"))["r"].alias("p"), "cnt")
        low = written(low)
        # who is nobody's choice leaves the graph; who is chosen goes on, joined to its own choice
        trees.append(written(low.filter("u <> p").select("u", "p").join(low.select(F.col("p").alias("u")).distinct(), "u", "left_anti")))
        one = lookup_join(graph, low, "u", n).select("v", F.col("p").alias("pu"))
        two = lookup_join(one, low.withColumnRenamed("u", "v"), "v", n)
        graph, n = written_counted(_both_ways(two.filter("pu <> p").select(F.col("pu").alias("u"), F.col("p").alias("v"))))
    done: list[DataFrame] = []  # u, root; the sets of the rounds shrink, so reading the later ones again stays cheap
    for tree in reversed(trees):
        if done:
            later = reduce(DataFrame.unionByName, done).select(F.col("u").alias("p"), "root")
            tree = tree.join(later, "p", "left").select("u", F.coalesce("root", "p").alias("root"))
        else:
            tree = tree.select("u", F.col("p").alias("root"))
        done.append(written(tree))
    every = vertices.select(F.col(uid).alias("u")).distinct()
    if not done:
        return every.select(F.col("u").alias(uid), F.col("u").alias("component"))
    rooted = every.join(reduce(DataFrame.unionByName, done), "u", "left").select("u", F.coalesce("root", "u").alias("root"))
    first = rooted.groupBy("root").agg(F.min("u").alias("component"))
    return rooted.join(first, "root").select(F.col("u").alias(uid), "component")


def _both_ways(e: DataFrame) -> DataFrame:
    """Each edge in either direction, once."""
    return e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").distinct()


def golden_ids(clusters: DataFrame, previous: DataFrame | None = None, prefix: str = "P") -> tuple[DataFrame, DataFrame | None]:
    """(cross-reference, retired ids). A known identifier stays with one component only.

    When a former person splits, the part with the most of its records (then the smallest component) keeps the
    identifier and the others get new ones; when persons merge, the smallest survives and the rest retire.
    """
    fresh = F.substring(F.sha2(F.concat(F.lit(prefix), F.col("component")), 256), 1, 36)
    if previous is None:
        return clusters.withColumn("patient_golden_id", fresh), None
    # a part that lost its identifier must not fall back on it, so its former one enters the new one
    former = previous.groupBy(F.col("record_uid").alias("component")).agg(F.min("patient_golden_id").alias("f"))
    fresh = F.substring(F.sha2(F.concat(F.lit(prefix), F.col("component"), F.coalesce("f", F.lit(""))), 256), 1, 36)
    votes = clusters.join(previous.select("record_uid", F.col("patient_golden_id").alias("g")), "record_uid").groupBy("component", "g").agg(F.count("*").alias("n"))
    owner = votes.groupBy("g").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("component").alias("c"))).alias("o")).select("g", F.col("o.c").alias("component"))
    kept = owner.groupBy("component").agg(F.min("g").alias("g"))
    xref = clusters.join(kept, "component", "left").join(former, "component", "left").withColumn("patient_golden_id", F.coalesce("g", fresh)).drop("g", "f")
    retired = previous.select("patient_golden_id").distinct().join(xref.select("patient_golden_id").distinct(), "patient_golden_id", "left_anti")
    return xref, retired


def confidence(xref: DataFrame, linked: DataFrame, alone: float = 99.0) -> DataFrame:
    """Weakest link of each person; a person of one record has ``alone``; with record count and sources."""
    e = linked.select(F.col("uid_a").alias("record_uid"), "match_score").join(xref.select("record_uid", "patient_golden_id"), "record_uid").groupBy("patient_golden_id").agg(F.min("match_score").alias("_m"))
    n = xref.groupBy("patient_golden_id").agg(F.count("*").alias("source_record_count"), F.concat_ws(",", F.sort_array(F.collect_set(F.split_part("record_uid", F.lit("|"), F.lit(1))))).alias("sources"))
    return n.join(e, "patient_golden_id", "left").withColumn("match_confidence", F.coalesce("_m", F.lit(alone))).drop("_m")


#: attributes of a golden record that identify a person, kept apart from the rest
PERSONAL = ("given", "family", "birth_date", "card", "postal", "phone")


def split_personal(golden: DataFrame, as_of: Column, *, salt: str, key: str = "patient_golden_id") -> tuple[DataFrame, DataFrame]:
    """(record without personal attributes, personal attributes): the former has birth year, age band, postal area and a card token instead."""
    open_part = golden.select("*", F.year("birth_date").alias("birth_year"), age_band("birth_date", as_of).alias("age_band"), postal_area("postal").alias("fsa"), token_of("card", salt).alias("patient_token")).drop(*PERSONAL)
    return open_part, golden.select(key, *PERSONAL)


def _shared_pairs(cells: DataFrame) -> int:
    """Pairs of records that share a cell, each once, from columns ``uid, c``; the pairs are never formed.

    Records with the same set of cells are counted together, so only different sets that share a cell meet.
    """
    sets = cells.groupBy("uid").agg(F.sort_array(F.collect_set("c")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    e = pin(sets).select("s", "n", F.explode("s").alias("c"))
    met = e.select("c", F.col("s").alias("s1"), F.col("n").alias("n1")).join(e.select("c", F.col("s").alias("s2"), F.col("n").alias("n2")), "c").filter("s1 <= s2").select("s1", "s2", "n1", "n2").distinct()
    pairs = F.when(F.col("s1") == F.col("s2"), F.expr("cast(n1 as decimal(19,0)) * (n1 - 1) div 2")).otherwise(F.expr("cast(cast(n1 as decimal(19,0)) * n2 as bigint)"))
    return int(met.agg(F.coalesce(F.sum(pairs), F.lit(0))).first()[0])


def _pair_counts(truth: DataFrame, predicted: DataFrame, uid: str, truth_group: str, predicted_group: str) -> tuple[int, int, int]:
    """True positive, false positive and false negative pairs; a pair counts once even if it shares several groups."""
    one = lambda df, g, c: df.select(F.col(uid).alias("uid"), F.col(g).cast("string").alias(c)).dropna().distinct()
    t, p = pin(one(truth, truth_group, "t")), pin(one(predicted, predicted_group, "p"))
    tp = _shared_pairs(t.join(p, "uid").select("uid", F.struct("t", "p").alias("c")))
    return tp, _shared_pairs(p.withColumnRenamed("p", "c")) - tp, _shared_pairs(t.withColumnRenamed("t", "c")) - tp


def pairwise_evaluation(truth: DataFrame, predicted: DataFrame, uid: str = "record_uid", truth_group: str = "person", predicted_group: str = "patient_golden_id") -> DataFrame:
    """Precision, recall and F1 over pairs, and how persons came out: split, merged with others, exact.

    ``exact`` counts persons neither split nor merged.
    """
    tp, fp, fn = _pair_counts(truth, predicted, uid, truth_group, predicted_group)
    both = truth.select(uid, F.col(truth_group).alias("t")).join(predicted.select(uid, F.col(predicted_group).alias("p")), uid)
    per_t = both.groupBy("t").agg(F.count_distinct("p").alias("n"), F.min("p").alias("p"))
    per_p = both.groupBy("p").agg(F.count_distinct("t").alias("m"))
    x = per_t.join(per_p, "p").agg(F.count("*").alias("people"), F.count_if(F.col("n") > 1).alias("split_people"), F.count_if((F.col("n") == 1) & (F.col("m") == 1)).alias("exact_people")).first()
    merged = per_p.filter("m > 1").count()
    prec, rec = tp / max(1, tp + fp), tp / max(1, tp + fn)
    row = (tp, fp, fn, prec, rec, 2 * prec * rec / max(1e-12, prec + rec) if tp else 0.0, x["people"], x["split_people"], merged, x["exact_people"])
    return truth.sparkSession.createDataFrame([row], "tp long, fp long, fn long, precision double, recall double, f1 double, people long, split_people long, merged_ids long, exact_people long")


