"""Each query of the catalogue against the SQL that says the same."""

import os

import pytest

import __spark_entry__ as entry
from nestql.catalogue import CATALOGUE

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_same_as_sql(spark, duck, name):
    run, sql = CATALOGUE[name]
    got = run(spark, SF).toArrow()
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.column_names) == sorted(names)
    rows = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in want.fetchall())
    assert sorted(map(repr, zip(*[got.column(c).to_pylist() for c in sorted(names)], strict=True))) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(CATALOGUE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
