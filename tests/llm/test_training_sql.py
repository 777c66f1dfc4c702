"""Training-data queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from partwise.llm import queries

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are missing")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    told = queries.QUERIES[name](spark, DATA)
    wanted = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(told.columns)
    rows = lambda found: sorted(map(str, map(tuple, found)))
    assert rows(told.select(*names).collect()) == rows(wanted.fetchall())


def test_warc_sql_knows_null_payloads_and_digests():
    con = duckdb.connect()
    con.execute("create table pages as select * from (values (1, null), (2, ''), (3, 'abc')) t(page_id, html)")
    rows = con.execute(f"select * from ({queries.ORACLE_SQL['op2_warc']}) order by page_id").fetchall()
    empty = "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert rows == [(1, 0, empty, "revisit", 2), (2, 0, empty, "response", None), (3, 3, "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5", "response", None)]
