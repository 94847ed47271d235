import glob
import os

import pytest

from skein.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    rel = c.sql(catalog.ORACLE_SQL[name])
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    want = sorted((tuple(r[rel.columns.index(k)] for k in cols) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r[k] for k in cols) for r in df.collect()), key=str) == want and want


def test_entry_without_the_training_operators():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
