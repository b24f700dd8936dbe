import os

import pytest

from cairnframe.llm import queries_llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries_llm.QUERIES))
def test_query_against_its_sql(spark, name):
    df = queries_llm.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert name == "p7_ids" or len(got) == len(set(got))
    if name in queries_llm.SQL:
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for f in os.listdir(SF):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        r = c.execute(queries_llm.SQL[name])
        at = [[d[0] for d in r.description].index(x) for x in cols]
        assert got == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())
