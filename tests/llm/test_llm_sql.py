"""Queries that SQL can express, against it."""

from __future__ import annotations

import duckdb
import pytest

from sightline.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    found = con.execute(llm.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall()), key=repr)
    df = llm.queries()[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr) == want
