from conftest import rows
from pyspark.sql import functions as F

from lamina.functions import scalar
from lamina.operators import identity as idn


def test_normalize_and_blocks(spark):
    src = spark.createDataFrame([("1", " Ann ", "LEE"), ("2", "Bob", None)], "pid string, fn string, ln string")
    n = idn.normalize(src, "EHR", {"source_id": "pid", "given": "fn", "family": "ln"}, {"given": F.trim})
    assert rows(n, "record_uid", "given") == [("EHR|1", "Ann"), ("EHR|2", "Bob")] and tuple(n.columns) == idn.CONTRACT
    assert rows(idn.blocks(n, {"F": [F.col("family"), F.col("given")]})) == [("EHR|1", "F|LEE|Ann")]


def test_oversized_blocks_are_reported_and_paired_in_tiles(spark):
    b = spark.createDataFrame([(f"r{i}", "big") for i in range(6)] + [("r1", "s"), ("r2", "s"), ("r3", "alone")], "record_uid string, block string")
    want = [(f"r{i}", f"r{j}") for i in range(6) for j in range(i + 1, 6)]
    for tile in (1, 2, 4, 100):
        assert rows(idn.block_pairs(b, tile)) == want
    assert rows(idn.oversized(b, 5)) == [("big", 6)]
    assert rows(idn.block_pairs(b.limit(0))) == []


def test_components_match_brute_force(spark):
    import random

    rng = random.Random(4)
    n = 120
    edges = [(f"n{rng.randrange(n):03}", f"n{rng.randrange(n):03}") for _ in range(70)] + [("n000", f"n{i:03}") for i in range(0, 60, 5)] + [("n001", "n001"), (None, "n002")]
    root = {f"n{i:03}": f"n{i:03}" for i in range(n)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    v = spark.createDataFrame([(x,) for x in root], "record_uid string")
    assert rows(idn.components(v, spark.createDataFrame(edges, "uid_a string, uid_b string"))) == sorted((x, find(x)) for x in root)
    assert len(rows(idn.components(v, spark.createDataFrame([], "uid_a string, uid_b string")))) == n


def test_personal_attributes_are_split_off(spark):
    g = spark.createDataFrame([("g", "A", "B", "1980-06-01", "123", "K1A0B1", "555", "F")], "patient_golden_id string, given string, family string, birth_date string, card string, postal string, phone string, sex string").withColumn("birth_date", F.to_date("birth_date"))
    rest, personal = idn.split_personal(g, F.lit("2024-01-01").cast("date"), salt="s")
    r = rest.first()
    assert (r.birth_year, r.age_band, r.fsa, r.sex) == (1980, "35-49", "K1A", "F") and not set(rest.columns) & set(idn.PERSONAL)
    assert personal.first().family == "B"


def test_scores_bands_and_missing(spark):
    ddl = "record_uid string, card string, birth_date date, family string, given string, sex string, postal string, phone string"
    p = spark.createDataFrame([("a", "1", None, "SMITH", "ANN", "F", "K1A0B1", None), ("b", "1", None, "SMITH", "ANNE", "F", "K1A9Z9", None), ("c", "2", None, "JONES", "BOB", "M", None, "x")], ddl).withColumn("birth_date", F.lit("1980-03-05").cast("date"))
    p = p.withColumn("birth_date", F.when(F.col("record_uid") == "b", F.lit("1980-05-03").cast("date")).otherwise(F.col("birth_date")))
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "uid_a string, uid_b string")
    got = {(r.uid_a, r.uid_b): r.match_score for r in idn.score(idn.with_sides(pairs, p)).collect()}
    assert got["a", "b"] == 12 + 5 + 4 - 2 + 1 + 1  # ANN / ANNE: one edit over five
    assert got["a", "c"] == -6 + 6 - 3 - 2 - 3 + 0 + 0
    s = spark.createDataFrame([("a", "b", 14.0), ("a", "c", 8.0), ("a", "d", 7.9), ("a", "e", 20.0)], "uid_a string, uid_b string, match_score double")
    o = spark.createDataFrame([("e", "a", "NO_MATCH"), ("d", "a", "MATCH"), ("a", "c", None)], "uid_a string, uid_b string, decision string")
    assert rows(idn.decide(s, o), "uid_b", "decision") == [("b", "AUTO_LINK"), ("c", "REVIEW"), ("d", "AUTO_LINK"), ("e", "DISTINCT")]
    assert rows(idn.review_queue(idn.decide(s)), "uid_b") == [("c",)]


def test_components_of_a_long_chain(spark):
    n = 60
    v = spark.createDataFrame([(f"n{i:03}",) for i in range(n)] + [("z",)], "record_uid string")
    e = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(n - 1)], "uid_a string, uid_b string")
    got = rows(idn.components(v, e))
    assert got == [(f"n{i:03}", "n000") for i in range(n)] + [("z", "z")]


def test_golden_ids_stay_split_and_merge(spark):
    c = lambda data: spark.createDataFrame(data, "record_uid string, component string")
    first, _ = idn.golden_ids(c([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]))
    old = {r.record_uid: r.patient_golden_id for r in first.collect()}
    split, retired = idn.golden_ids(c([("a", "a"), ("b", "b"), ("c", "b"), ("d", "d")]), first)
    new = {r.record_uid: r.patient_golden_id for r in split.collect()}
    assert new["b"] == new["c"] == old["a"] and new["a"] != old["a"] and new["d"] == old["d"] and retired.count() == 0
    merged, retired = idn.golden_ids(c([("a", "a"), ("b", "a"), ("c", "a"), ("d", "a")]), first)
    assert {r.patient_golden_id for r in merged.collect()} == {min(old.values())} and rows(retired) == [(max(old.values()),)]
    conf = idn.confidence(first, spark.createDataFrame([("a", "b", 20.0), ("b", "c", 15.0)], "uid_a string, uid_b string, match_score double"))
    assert sorted(r.match_confidence for r in conf.collect()) == [15.0, 99.0]


def test_evaluation_sees_false_merges(spark):
    t = spark.createDataFrame([("1", "p"), ("2", "p"), ("3", "q"), ("4", "r")], "record_uid string, person string")
    p = spark.createDataFrame([("1", "g"), ("2", "g"), ("3", "g"), ("4", "h")], "record_uid string, patient_golden_id string")
    r = idn.pairwise_evaluation(t, p).first()
    assert (r.tp, r.fp, r.fn, r.exact_people, r.merged_ids, r.split_people) == (1, 2, 0, 1, 1, 0)
    none = idn.pairwise_evaluation(t.limit(0), p.limit(0)).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_pairwise_evaluation_counts_without_pairs(spark):
    n = 100_000  # five billion pairs
    t = spark.range(n).select(F.col("id").alias("record_uid"), F.lit(1).alias("person"))
    p = t.select("record_uid", (F.col("record_uid") % 2).alias("patient_golden_id"))
    pairs = lambda k: k * (k - 1) // 2
    r = idn.pairwise_evaluation(t, p).first()
    assert (r.tp, r.fp, r.fn) == (2 * pairs(n // 2), 0, pairs(n) - 2 * pairs(n // 2))
    # records of several groups: a pair that shares two of them counts once
    t = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (2, "b"), (3, None)], "record_uid int, person string")
    p = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "record_uid int, patient_golden_id string")
    r = idn.pairwise_evaluation(t, p).first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 0)


def _wide(df):
    """Operators through which pairs would move between tasks, after the join that makes them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("Join")]


def _crowd(spark, n=60):
    """Records of two large blocks and some small ones, with attributes; and their blocks."""
    p = spark.range(n).select(F.format_string("r%03d", F.col("id")).alias("record_uid"), (F.col("id") % 7).cast("string").alias("card"), F.date_add(F.lit("1980-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("birth_date"), F.when(F.col("id") % 5 == 0, "SMITHSON").otherwise("SMITHSEN").alias("family"), F.lit("ANN").alias("given"), F.lit("F").alias("sex"), F.when(F.col("id") % 2 == 0, "K1A0B1").alias("postal"), (F.col("id") % 4).cast("string").alias("phone"))
    return p, idn.blocks(p, {"card": [F.col("card")], "area": [F.col("given"), F.col("postal")], "phone": [F.col("phone"), F.col("sex")]})


def test_overrides_of_the_pair_itself_need_no_join(spark):
    """match_override: as a column, overrides decide like the same ones in a table, and no pair moves."""
    p, b = _crowd(spark)
    s = idn.score(idn.paired(b, p, 4)).select("uid_a", "uid_b", "match_score")
    n = F.right("uid_a", F.lit(1)).cast("int") % 3
    rule = F.when(n == 0, "NO_MATCH").when(n == 1, "MATCH")
    table = s.select(F.col("uid_b").alias("uid_a"), F.col("uid_a").alias("uid_b"), rule.alias("decision"))
    by_rule = idn.decide(s, rule)
    assert rows(by_rule, "uid_a", "uid_b", "decision") == rows(idn.decide(s, table), "uid_a", "uid_b", "decision")
    assert "Exchange" not in _wide(by_rule)


def test_paired_is_pairs_with_sides_and_no_pair_moves(spark):
    p, b = _crowd(spark)
    for tile in (3, 1000):
        got = idn.paired(b, p, tile)
        want = idn.with_sides(b.withColumnRenamed("record_uid", "uid_a").join(b.withColumnRenamed("record_uid", "uid_b"), "block").filter("uid_a < uid_b").select("uid_a", "uid_b").distinct(), p)
        assert rows(got.select(*want.columns).withColumns({c: F.coalesce(c, F.lit("")) for c in want.columns if "birth" not in c})) == rows(want.withColumns({c: F.coalesce(c, F.lit("")) for c in want.columns if "birth" not in c}))
        assert "Exchange" not in _wide(got)


def test_scores_from_some_height_are_those_of_all_pairs(spark):
    """review_queue: who cannot reach the height is dropped before the costly comparisons, nobody else is."""
    p, b = _crowd(spark)
    sides = idn.paired(b, p)
    every = idn.score(sides).select("uid_a", "uid_b", "match_score")
    for least in (-30.0, 2.5, 8.0, 14.0, 100.0):
        assert rows(idn.score(sides, at_least=least).select("uid_a", "uid_b", "match_score")) == rows(every.filter(F.col("match_score") >= least))
    assert 0 < every.filter("match_score >= 14").count() < every.count()


def test_block_pairs_come_once_without_comparing_pairs(spark):
    """block_pairs: a pair that shares two blocks comes from the larger one; no distinct runs over the pairs."""
    p, b = _crowd(spark)
    got = idn.block_pairs(b, 5)
    want = b.withColumnRenamed("record_uid", "uid_a").join(b.withColumnRenamed("record_uid", "uid_b"), "block").filter("uid_a < uid_b").select("uid_a", "uid_b")
    assert rows(got) == rows(want.distinct()) and want.count() > want.distinct().count()
    assert "Exchange" not in _wide(got) and "Aggregate" not in _wide(got)


def test_spanning_keeps_persons_and_weakest_links(spark, monkeypatch):
    """connected_components, person_confidence: ties that close a circle go, also when a task thins them in between."""
    import random

    rng = random.Random(7)
    monkeypatch.setattr(idn, "HELD", 40)
    links = spark.createDataFrame([(f"n{x:03}", f"n{y:03}", float(rng.randrange(14, 40))) for g in range(6) for x in range(g * 20, g * 20 + 20) for y in range(x + 1, g * 20 + 20)], "uid_a string, uid_b string, match_score double").coalesce(1)
    few = idn.spanning(links)
    assert few.count() == 6 * 19 and links.count() == 6 * 190
    v = spark.range(125).select(F.format_string("n%03d", F.col("id")).alias("record_uid"))
    c = idn.components(v, few)
    assert rows(c) == rows(idn.components(v, links)) == sorted((f"n{i:03}", f"n{i // 20 * 20:03}" if i < 120 else f"n{i:03}") for i in range(125))
    x, _ = idn.golden_ids(c)
    assert rows(idn.confidence(x, few)) == rows(idn.confidence(x, links))


def test_spanning_thins_scores_that_are_never_null(spark, monkeypatch):
    """connected_components: batches that come after a task thinned its ties join them, with scores that cannot be null, as those of decisions are."""
    monkeypatch.setattr(idn, "HELD", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 15)
    try:
        links = spark.range(1, 400, numPartitions=1).select(F.lit("n000").alias("uid_a"), F.format_string("n%03d", F.col("id")).alias("uid_b"), (F.col("id") + 14.0).alias("match_score"))
        links = links.unionByName(links.select(F.col("uid_b").alias("uid_a"), F.format_string("n%03d", F.substring("uid_b", 2, 3).cast("int") % 399 + 1).alias("uid_b"), F.lit(14.0).alias("match_score"))).coalesce(1)
        assert not links.schema["match_score"].nullable
        few = idn.spanning(links)
        assert few.count() == 399 and rows(few.agg(F.min("match_score"))) == [(14.0,)]
        v = spark.range(401).select(F.format_string("n%03d", F.col("id")).alias("record_uid"))
        assert rows(idn.components(v, links)) == sorted((f"n{i:03}", "n000" if i < 400 else f"n{i:03}") for i in range(401))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _thinned_like_sql(spark, folder, monkeypatch, name):
    """The query on customers with many links, thinned in between, and its SQL in DuckDB; persons, some of one record."""
    import duckdb

    from lamina.plans import registry
    from lamina.session import ship

    c = duckdb.sql("select i as c_custkey, format('Customer#{:09d}', i) as c_name, (i % 2)::int as c_nationkey, case when i % 60 = 7 then i * 20.0 else (i % 3) * 100.0 end as c_acctbal, case when i % 4 = 0 then 'BUILDING' else 'MACHINERY' end as c_mktsegment from range(240) t(i)")
    c.write_parquet(f"{folder}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{folder}/customer.parquet'")
    monkeypatch.setattr(idn, "HELD", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 15)
    try:
        want = con.execute(registry.SQL[name])
        names = [x[0] for x in want.description]
        return rows(registry.QUERIES[name](ship(spark), str(folder)), *names), sorted(want.fetchall())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_person_confidence_with_thinned_links(spark, tmp_path, monkeypatch):
    """person_confidence: the weakest link of each person is the same when tasks thin their links before the last batch."""
    got, want = _thinned_like_sql(spark, tmp_path, monkeypatch, "person_confidence")
    assert got == want and len({r[-1] for r in want}) > 1 and max(r[1] for r in want) > 40


def test_golden_ids_with_thinned_links(spark, tmp_path, monkeypatch):
    """golden_ids: every record has the identifier it has in SQL when tasks thin their links before the last batch."""
    got, want = _thinned_like_sql(spark, tmp_path, monkeypatch, "golden_ids")
    assert got == want and len(got) == 240 and 3 < len({g for _, g in want}) < 20


def _moved_into_tiles(df):
    """Shuffles by tile that were really made."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return sum("Exchange hashpartitioning(block" in line and ", i#" in line and "ReusedExchange" not in line for line in plan.splitlines())


def test_tiles_are_shuffled_once_for_both_sides(spark):
    """block_pairs: both sides of a tile read the same shuffled rows, whether blocks are cut or not."""
    p, b = _crowd(spark)
    for tile in (5, 1000):
        assert _moved_into_tiles(idn.block_pairs(b, tile)) == _moved_into_tiles(idn.paired(b, p, tile)) == 1


def test_records_that_carry_their_blocks_make_the_same_pairs(spark):
    """block_pairs: identifiers that repeat, with other blocks, or are missing; blocks of any size."""
    p, _ = _crowd(spark, 40)
    p = p.unionByName(p.filter("card < '3'").withColumn("card", F.lit("5")).withColumn("phone", F.lit(None).cast("string"))).unionByName(p.limit(9).withColumn("record_uid", F.lit(None).cast("string")))
    keys = {"card": [F.col("card")], "area": [F.col("given"), F.col("postal")], "phone": [F.col("phone"), F.col("sex")]}
    b = idn.blocks(p, keys).filter("record_uid is not null")
    want = b.withColumnRenamed("record_uid", "uid_a").join(b.withColumnRenamed("record_uid", "uid_b"), "block").filter("uid_a < uid_b").select("uid_a", "uid_b").distinct()
    text = lambda df: df.select("uid_a", "uid_b", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("a_card", "b_card", "a_phone", "b_phone")])
    for tile in (3, 1000):
        assert rows(idn.pairs_by(p, keys, tile)) == rows(idn.block_pairs(idn.blocks(p, keys), tile)) == rows(want)
        assert rows(text(idn.paired_by(p, keys, tile))) == rows(text(idn.with_sides(want, p)))


def test_blocks_are_split_by_what_must_agree(spark):
    """golden_ids: pairs that cannot be linked without the same card are not made; those that lack a card are."""
    p, _ = _crowd(spark)
    keys = {"card": [F.col("card")], "area": [F.col("given"), F.col("postal")], "phone": [F.col("phone"), F.col("sex")]}
    assert [c.field for c in idn.COMPARATORS if c.must_agree(idn.COMPARATORS, idn.LINK_AT)] == ["card"]
    for some in (p, p.withColumn("card", F.when(~F.col("record_uid").endswith("1"), F.col("card")))):
        every = idn.score(idn.paired(idn.blocks(some, keys), some)).select("uid_a", "uid_b", "match_score")
        for least in (-30.0, 8.0, idn.LINK_AT, 18.0):
            for tile in (4, 1000):
                got = idn.score(idn.paired_by(some, keys, tile, least), at_least=least).select("uid_a", "uid_b", "match_score")
                assert rows(got) == rows(every.filter(F.col("match_score") >= least))
    made = idn.paired_by(p, keys, at_least=idn.LINK_AT)
    assert made.filter("a_card <> b_card").isEmpty() and 0 < 3 * made.count() < every.count()


def test_sketches_decide_like_the_comparisons_they_save(spark):
    """match_decision: names and dates of pairs are told apart by numbers made once per record, with the same scores."""
    import random

    rng = random.Random(11)
    names = ["", "A", "AB", "ABCDE", "Customer#000000123", "Ålesund-Østby", "李小龙", "😀😀😀😀😀", "X" * 200]
    for _ in range(50):
        n = list(rng.choice(names))
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(n) + 1)
            n[at : at + rng.randrange(2)] = rng.choice(["", "A", "1", "é", "😀"])
        names.append("".join(n))
    v = spark.createDataFrame([(n,) for n in sorted(set(names))], "n string")
    for least in (0.5, 0.88, 0.9):
        side = lambda s, least=least: v.select(F.col("n").alias(s), scalar.name_sketch("n", least).alias(f"{s}_s"))
        got = side("a").crossJoin(side("b")).select("a", "b", scalar.names_alike("a", "b", least, (F.col("a_s"), F.col("b_s"))).alias("got"), (scalar.name_similarity("a", "b") >= least).alias("want"))
        assert got.filter("not got <=> want").isEmpty() and got.filter("want and a <> b").count() > 20
    p, b = _crowd(spark)
    p = p.withColumn("birth_date", F.when(F.col("record_uid") == "r003", F.lit("1980-03-01").cast("date")).otherwise(F.col("birth_date")))
    made = idn.paired(b, p, 4)
    assert {f"a_{idn.SKETCH}{c}" for c in ("birth_date", "family", "given")} <= set(made.columns)
    plain = made.drop(*[c for c in made.columns if idn.SKETCH in c])
    scored = idn.score(made)
    assert scored.columns == idn.score(plain).columns
    for least in (None, 8.0):
        assert rows(idn.score(made, at_least=least), "uid_a", "uid_b", "match_score") == rows(idn.score(plain, at_least=least), "uid_a", "uid_b", "match_score")
    # made in the tile: the shuffles carry no sketch, and no field of a date is taken out of a pair
    plan = scored.select("uid_a", "uid_b", "match_score")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "year(" not in plan[: plan.index("Join")] and "sketch_of_" in plan
    assert all("sketch_of_" not in x for x in plan[plan.index("Exchange hashpartitioning(block") :].split("\n")[1:4])
