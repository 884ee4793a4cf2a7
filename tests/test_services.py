import pytest
from conftest import rows
from pyspark.sql import functions as F

from lamina.operators import access, conforming, quality
from lamina.plans import emitters
from lamina.session import pin_counted, release, shared_dir
from lamina.sources import control, files, rest


def test_emitters_on_empty_null_and_tied_rows(spark):
    o = spark.createDataFrame([(i, f"2024-01-{1 + i % 20:02}") for i in range(200)] + [(900, None)], "k int, day string")
    got = emitters.daily_batches(o, "day", ["k"], every=7, days=2, per_day=3)
    assert rows(got.groupBy("day").count()) == [("2024-01-01", 3), ("2024-01-08", 3)]
    assert emitters.daily_batches(o.limit(0), "day", ["k"]).count() == 0
    c = emitters.chunks(o, "day", ["k"], 4)
    assert max(r.chunk for r in c.collect()) == 2
    n = emitters.next_ids(spark.createDataFrame([("A007",), ("Axx",), (None,)], "id string"), spark.createDataFrame([("p",), ("q",)], "v string"), key="id", prefix="A", order=["v"], width=3)
    assert rows(n, "v", "id") == [("p", "A008"), ("q", "A009")]
    first = emitters.next_ids(spark.createDataFrame([], "id string"), spark.createDataFrame([("p",)], "v string"), key="id", prefix="A", order=["v"], width=3)
    assert rows(first, "id") == [("A001",)]
    s = emitters.insert_statements(spark.createDataFrame([(1, "O'Hara"), (2, ""), (3, None)], "k int, v string"), "t", ["k", "v"], ["k"], 2)
    assert rows(s) == [(0, "INSERT INTO t (k, v) VALUES ('1', 'O''Hara'), ('2', NULL)"), (1, "INSERT INTO t (k, v) VALUES ('3', NULL)")]
    p = emitters.panels(spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "z")], "e int, n int, code string"), spark.createDataFrame([("a", "P"), ("b", "P"), ("b", "P")], "code string, panel string"), code="code", by=["e"], order="n")
    assert rows(p, "panel", "codes") == [("P", ["a", "b"]), ("z", ["z"])]
    d = emitters.changes(spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), spark.createDataFrame([(1, None), (2, "y"), (3, "z")], "k int, v string"), ["k"], ["v"])
    assert rows(d, "k", "change") == [(1, "redelivered"), (2, "changed"), (3, "new")]


def test_page_server_refuses_as_the_protocol_says():
    now = [0.0]
    s = rest.PageServer({"patient": ([{"id": str(i), "u": f"{i:02}", "h": "A"} for i in range(5)], "id", "u")}, ("me", "pw"), limit=4, clock=lambda: now[0])
    status = lambda f: pytest.raises(rest.RestError, f).value.status
    assert status(lambda: s.token("me", "no")) == 401 and status(lambda: s.get("patient", {}, "none")) == 401
    t = s.token("me", "pw")
    assert [r["id"] for r in rest.all_pages(lambda p: s.get("patient", p, t), 2)] == list("01234")
    assert status(lambda: s.get("other", {}, t)) == 404
    assert status(lambda: s.get("patient", {}, t)) == 429
    now[0] = 61
    assert status(lambda: s.get("patient", {"cursor": "%%"}, t)) == 400
    assert s.get("patient", {"limit": 0, "h": "B"}, t)["pagination"]["limit"] == 1
    now[0] = 901
    assert status(lambda: s.get("patient", {}, t)) == 401


def test_registry_rows_are_checked(spark):
    one = {"source_system": "S", "entity_name": "e", "connection_type": "csv"}
    r = control.source_registry(spark, [one]).first()
    assert (r.is_active, r.load_type, r.priority, r.watermark_column) == (True, "full", 1, None)
    for bad in ([one, one], [one | {"connection_type": "fax"}], [one | {"load_type": "incremental"}]):
        with pytest.raises(ValueError):
            control.source_registry(spark, bad)


def test_only_breached_rules_set_rows_aside(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "k int, v int")
    rules = [quality.Rule("a", "v > 0", action="Quarantine"), quality.Rule("b", "k > 0", action="Quarantine"), quality.Rule("c", "v is not null"), quality.Rule("d", "nothing > 0", action="Quarantine")]
    assert rows(quality.breached_rows(df, rules, quality.evaluate(df, rules)), "k", "_dq_rule_id") == [(2, "a"), (3, "a")]
    assert quality.breached_rows(df, rules[1:3], quality.evaluate(df, rules[1:3])) is None


def test_malformed_lines_within_a_limit(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\n4,5,6\n7,8\n")
    t = files.text_table(spark, str(tmp_path / "x.csv"), ["a", "b"], bad_rows=True)
    assert rows(files.within_errors(t, 2)) == [("1", "2"), ("7", "8")]
    with pytest.raises(ValueError):
        files.within_errors(t, 1)


def test_codes_by_system_and_hidden_columns(spark):
    m = spark.createDataFrame([("D", "A", "x", "AX", "true"), ("D", "B", "x", "BX", "true"), ("D", "A", "X ", "AX", "true")], "domain string, source_system string, source_code string, standard_code string, is_active string")
    df = spark.createDataFrame([("A", "x"), ("B", " X"), ("C", "x"), (None, "x"), ("A", None)], "s string, c string")
    got = conforming.map_codes_by_system(df, m, domain="D", system="s", source="c", target="t")
    assert sorted((r.s or "", r.t) for r in got.collect()) == [("", "UNKNOWN"), ("A", "AX"), ("A", "UNKNOWN"), ("B", "BX"), ("C", "UNKNOWN")]
    hidden = spark.createDataFrame([("t", "c", "R"), ("t", "zzz", "R"), ("u", "s", "R")], "table_name string, column_name string, role_name string")
    assert access.allowed_columns(df, "t", hidden, ["R"]).columns == ["s"] and access.allowed_columns(df, "t", hidden, ["Q"]).columns == ["s", "c"]


def test_pins_count_and_can_be_released(spark):
    df, n = pin_counted(spark.range(37).filter(F.col("id") % 2 == 0))
    assert n == df.count() == 19
    assert shared_dir(spark)
    before = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert len(fs.listStatus(path)) > 0
    release(spark)
    assert len(fs.listStatus(path)) == 0
    assert pin_counted(spark.range(3))[1] == 3
