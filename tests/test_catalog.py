"""Every query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quillgraph import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_query(spark, db, name):
    got, want = catalog.queries()[name](spark, FOLDER).toPandas(), db.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda x: sorted(map(tuple, x[columns].astype(str).values.tolist()))
    assert order(got) == order(want)


def test_what_has_no_sql_is_said():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == set(catalog.WITHOUT_SQL)
    assert set(catalog.queries()) <= set(entry.queries()) and set(catalog.oracle_sql()) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["c", "r"] and entry.entry(spark).count() > 0
