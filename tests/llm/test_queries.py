"""Registered queries against their SQL on the small tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from parlance.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted(tuple(map(str, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert rows_of(QUERIES[name](spark, DATA).toPandas()) == rows_of(con.execute(ORACLES[name]).df())
