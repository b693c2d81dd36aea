import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    want = con.execute(queries.SQL[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert len(want) > 0 and sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].values)) == sorted(map(tuple, want[columns].values))
