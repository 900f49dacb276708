import glob
import os

import duckdb
import pytest


@pytest.fixture(scope="session")
def oracle():
    """Rows of an SQL twin over a folder of tables, as sorted tuples with columns by name."""

    def run(sql, folder):
        db = duckdb.connect()
        for path in glob.glob(f"{folder}/*.parquet"):
            name = os.path.basename(path)[:-8]
            db.execute(f"create view {name} as select * from read_parquet('{path}')")
        out = db.sql(sql)
        order = sorted(range(len(out.columns)), key=lambda i: out.columns[i])
        return [out.columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in out.fetchall()), key=repr)

    return run


@pytest.fixture(scope="session")
def rows_of():
    def run(df):
        names = sorted(df.columns)
        return names, sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)

    return run
