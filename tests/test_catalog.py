"""Each query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from spectraloom.plans import load

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

catalog = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, columns):
    def one(x):
        if isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are absent")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), names)
