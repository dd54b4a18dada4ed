"""The driver's entry: every query with an oracle returns the oracle's rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from astraloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_flagship(spark, sf):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.queries()[name](spark, sf)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    order = [want.columns.index(c) for c in got.columns]
    assert sorted((tuple(map(near, r)) for r in got.collect()), key=repr) == sorted((tuple(near(r[i]) for i in order) for r in want.fetchall()), key=repr)
