import pytest
from conftest import rows

from lamina.operators import quality as q


def test_quarantine_null_fails(spark):
    ok, bad = q.quarantine(spark.createDataFrame([(1,), (None,), (9,)], "x int"), "x < 5", "too big")
    assert rows(ok) == [(1,)] and sorted((r.x is None, r._dq_reason) for r in bad.collect()) == [(False, "too big"), (True, "too big")]


def test_rules(spark):
    df = spark.createDataFrame([("a", 1, "b1"), ("a", 2, "b1"), ("c", None, "b2")], "k string, v int, _batch_id string")
    parent = spark.createDataFrame([("a",)], "id string")
    rules = [q.Rule("R-1", "v > 0", 60.0), q.Rule("R-2", "k", kind="unique"), q.Rule("R-3", "k", kind="reference", parent=(parent, "id")), q.Rule("R-4", "nope > 1", severity="Error")]
    got = {r.rule_id: r for r in q.evaluate(df, rules).collect()}
    assert (got["R-1"].rows_passed, got["R-1"].is_breach) == (2, False) and got["R-2"].rows_failed == 2 and got["R-3"].rows_failed == 1
    assert got["R-4"].status == "EXPRESSION_ERROR" and got["R-4"].is_breach
    scoped = {r.rule_id: r for r in q.evaluate(df, rules[:1], batch_id="b2").collect()}
    assert scoped["R-1"].rows_evaluated == 1
    empty = q.evaluate(df.limit(0), rules[:1]).first()
    assert empty.pass_rate_pct == 100.0 and not empty.is_breach
    assert q.evaluate(df, []).count() == 0
    assert rows(q.failing_rows(df, rules[0]), "k", "_dq_rule_id") == [("c", "R-1")]


def test_gate_and_keys(spark):
    df = spark.createDataFrame([(1,)], "v int")
    res = q.evaluate(df, [q.Rule("A", "v > 5", severity="Error", action="FailBatch"), q.Rule("B", "v > 5")])
    with pytest.raises(q.QualityGateError, match="A"):
        q.gate(res)
    q.gate(res.filter("rule_id = 'B'"))
    keyed = q.with_rule_keys(res, spark.createDataFrame([("A", 7)], "rule_id string, dq_rule_key int"))
    assert rows(keyed, "rule_id", "dq_rule_key") == [("A", 7), ("B", -1)]


def test_counts(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "g string"), spark.createDataFrame([("x",), ("y",)], "g string")
    assert rows(q.reconcile(a, b, ["g"])) == [("x", 2, 1)]
    f = spark.createDataFrame([(1, -1), (2, -1), (-1, 3), (4, 4)], "a int, b int")
    assert rows(q.unknown_rates(f, ["a", "b"])) == [("a", 25.0), ("b", 50.0)]
    assert q.resolution_rate(spark.createDataFrame([("g",), (None,)], "g string"), "g").first()[:] == (2, 1, 50.0)
