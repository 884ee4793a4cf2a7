"""Every core query that has SQL, against DuckDB on the smallest shared tables."""

from pathlib import Path

import duckdb
import pytest

from lamina.plans import registry
from lamina.session import ship

DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="shared tables are not here")


def norm(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in DIR.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](ship(spark), str(DIR))
    cur = duck.execute(registry.SQL[name])
    names = [c[0] for c in cur.description]
    cols = sorted(names)
    assert sorted(got.columns) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in got.collect()) == want
