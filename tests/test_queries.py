import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessella.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(df):
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return None
        return f"{float(v):.6f}" if isinstance(v, (float, np.floating)) or type(v).__name__ == "Decimal" else str(v)

    return sorted([tuple(map(cell, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False)], key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    assert len(got) > 0
    if name in catalogue.SQL:
        assert plain(got) == plain(duck.execute(catalogue.SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_report_lines_of_unevenly_merged_partitions(spark):
    """Adaptive execution must not merge partitions of one side of a union that a join reads in place."""
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        got = entry.queries()["q_shacl_lines"](spark, "/root/testdata/sf0.01").toPandas()
    finally:
        for key in small:
            spark.conf.unset(key)
    con = duckdb.connect()
    for name in ("s1_output", "evidences"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    assert plain(got) == plain(con.execute(catalogue.SQL["q_shacl_lines"]).df())
