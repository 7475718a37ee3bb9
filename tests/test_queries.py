import glob
import os

import pytest

import __spark_entry__ as entry
from quadrille.plans import catalogue, stack_catalogue, stream_catalogue  # noqa: F401

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return "~" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


def key(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in catalogue.ORACLES:
        assert rows
        return
    want = db.sql(catalogue.ORACLES[name])
    assert {c: TYPES[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert key(got.columns, rows) == key(want.columns, want.fetchall())


def test_generated_pixels_grow_with_the_tables(spark, db):
    times, bands = db.sql("SELECT count(DISTINCT user_id), count(DISTINCT event_type) FROM events").fetchall()[0]
    got = catalogue.QUERIES["fake_reader_scan"](spark, SF)
    assert got.count() == times * bands * 256
    assert got.selectExpr("max(time_idx)", "max(band_idx)").first() == (times - 1, bands - 1)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
