import os

import duckdb
import pytest

from tallylog import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n.startswith("page_") and n != "page_bookmark_flag"])
def test_rows_beyond_ten_million_events_are_paged(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (event_id + 20000000 AS event_id) FROM '{DATA}/events.parquet') TO '{tmp_path}/events.parquet'")
    os.symlink(f"{DATA}/pages.parquet", tmp_path / "pages.parquet")
    for table in ("events", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    names = sorted(got.columns)
    want = con.execute(catalog.ORACLE[name])
    at = [[d[0] for d in want.description].index(n) for n in names]
    rows = sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == rows
    assert rows or name in ("page_null_segment", "page_status_500")
