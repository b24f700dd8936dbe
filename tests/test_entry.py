import os
import sys

import pytest

from cairnframe.plans import queries_core, queries_inventory

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SQL = queries_core.SQL | queries_inventory.SQL
QUERIES = queries_core.QUERIES | queries_inventory.QUERIES


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    if name in SQL:
        r = duck.execute(SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())


def test_entry_without_the_text_operators(spark, monkeypatch):
    for m in [m for m in sys.modules if m.startswith("cairnframe.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "cairnframe.llm", None)
    import __spark_entry__ as e

    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(SQL)
    assert e.entry(spark).count() >= 0
    monkeypatch.delitem(sys.modules, "__spark_entry__")
