"""The shards of the given documents against plain window functions in DuckDB,
which has no crc32: that column is compared with zlib."""

from __future__ import annotations

import zlib

import duckdb

from papertally.llm import sharding
from papertally.llm.registry import QUERIES


def test_shards_as_windows_give_them(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    expected = {r[0]: r for r in con.execute(sharding.SQL).fetchall()}
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES["op7_sharding"](spark, folder).collect()
    assert len(rows) == len(expected)
    for r in rows:
        assert (r.doc_id, r.source, r.size, r.law, r.shard, r.slot, r.grown_shard) == expected[r.doc_id]
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
