"""The flagship query exports the whole table."""

from __future__ import annotations

import duckdb

import __spark_entry__
from parlance.plans.catalogue import _MARKDOWN
from tests.test_catalogue import DATA, rows_of


def test_entry_exports_every_turn(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    found = __spark_entry__.entry(spark).toPandas()
    assert rows_of(found) == rows_of(con.execute(_MARKDOWN).df())
    counts = dict(con.execute("SELECT conv_id, count(*) FROM conversations GROUP BY 1").fetchall())
    assert all(f'message_count: "{counts[r.conv_id]}"' in r.content for r in found.itertuples())
