import os

import duckdb
import pytest

from quern.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_the_other_engine(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    found = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(rows, df.columns) == normal(found.fetchall(), columns)


@pytest.mark.parametrize("name", ["order_nulls_whole", "order_nulls_desc_whole"])
def test_whole_orders_keep_their_order(spark, duck, name):
    rows = [tuple(r) for r in catalogue.QUERIES[name](spark, DIR).collect()]
    assert rows == duck.execute(catalogue.ORACLES[name]).fetchall()
    assert len({s for _, s in rows}) > 2


def test_null_join_meets_whole_tables(spark, duck):
    rows = catalogue.QUERIES["join_legacy_nulls_whole"](spark, DIR).collect()
    nulls = duck.execute("SELECT count(*) FROM orders WHERE o_orderstatus = 'F'").fetchone()[0]
    assert nulls > 100 and max(r.o_orderkey for r in rows) > 300 and len(rows) >= nulls
