"""Each query against its SQL on DuckDB over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from fieldweave.jobs.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def key(row):
    return tuple((v is None, round(v, 4) if isinstance(v, float) else v if v is not None else 0) for v in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    query = QUERIES[name]
    frame = query(spark, SF)
    names = [c for c, _ in query.kinds()]
    assert frame.columns == names
    rows = sorted((tuple(r) for r in frame.collect()), key=key)
    assert rows
    if query.sql:
        wanted = sorted(duck.sql(f"SELECT {', '.join(names)} FROM ({query.oracle()})").fetchall(), key=key)
        assert len(rows) == len(wanted)
        assert all(same(x, y) for r, w in zip(rows, wanted, strict=True) for x, y in zip(r, w, strict=True))
