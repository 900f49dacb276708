"""Every registered query against its DuckDB twin, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidemark.plans.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_twin(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    out = db.sql(ORACLE[name])
    order = sorted(range(len(out.columns)), key=lambda i: out.columns[i])
    assert names == [out.columns[i] for i in order]
    assert ours == sorted((tuple(plain(r[i]) for i in order) for r in out.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_queries_without_a_twin_return_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
