"""The llm queries that have SQL, against DuckDB, and the others for shape, on the smallest shared tables."""

from pathlib import Path

import duckdb
import pytest

from lamina.llm import queries
from lamina.session import ship

DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="shared tables are not here")

COLUMNS = {"p3_found": ["uid_a", "uid_b"], "p4_found": ["patient_golden_id", "field_name", "record_uid"], "p5_found": ["record_uid", "group_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in DIR.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](ship(spark), str(DIR))
    cur = duck.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(str(r[names.index(c)]) for c in got.columns) for r in cur.fetchall())
    assert sorted(tuple(str(v) for v in r) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_columns_and_no_repeats(spark, name):
    df = queries.QUERIES[name](ship(spark), str(DIR))
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == len(set(rows))


def test_scores_cover_every_document_and_sources(spark):
    n = spark.read.parquet(str(DIR / "documents.parquet")).count()
    s = queries.p10_scores(ship(spark), str(DIR))
    assert s.count() == n and s.filter("score < 0 or score > 1 or score is null").count() == 0
    fill = queries.p8_fill(spark, str(DIR)).first()
    assert fill.used > 0.8
