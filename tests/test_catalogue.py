"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from parlance.plans import catalogue, pages

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.QUERIES | pages.QUERIES, catalogue.ORACLES | pages.ORACLES


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted((tuple(map(str, r)) for r in frame.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert len(found)
        return
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert rows_of(found) == rows_of(con.execute(ORACLES[name]).df())
