"""Every query of the library against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from sightline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    rows = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert rows or not df.columns
        return
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
