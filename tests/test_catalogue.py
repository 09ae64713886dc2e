"""Every core query against its DuckDB twin."""

from pathlib import Path

import duckdb
import pytest

from nearsieve.plans.catalogue import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the generated tables are missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, str(DATA))
    rows = found.collect()
    assert rows
    if name in ORACLES:
        twin = duck.execute(ORACLES[name])
        columns = [c[0] for c in twin.description]
        assert sorted(found.columns) == sorted(columns)
        assert normal(rows, found.columns) == normal(twin.fetchall(), columns)
