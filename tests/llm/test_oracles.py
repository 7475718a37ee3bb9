import glob
import os

import pytest

from quadrille.llm import queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = db.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert {c: TYPES[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    rows = got.select(*want.columns).collect()
    assert rows and sorted(map(tuple, rows), key=str) == sorted(want.fetchall(), key=str)
