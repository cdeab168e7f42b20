"""The SQL twins of operators whose own tests do not run them."""

import duckdb
import pytest

from ironlift.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_arc_to_warc", "op4_decontaminate", "op7_near_duplicates"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = QUERIES[name](spark, D)
    want = con.execute(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key) and len(want) > 0
