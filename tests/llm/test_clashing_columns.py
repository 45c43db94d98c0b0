"""Columns of the caller's that are named like those of an operator's steps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from papertally.llm.fingerprints import without_copies
from papertally.llm.mixing import mix
from papertally.llm.sharding import interleave

NAMES = [
    "_bucket", "_inner", "_at", "_size", "_offset", "__shard_key", "__shard_rank", "__shard_place", "__shard_stratum", "_leaf", "leaf", "_whole",
    "_rest", "_cut", "_end", "_start", "_before", "_sum", "_key", "tokens", "budget", "parent", "given", "own_0", "own_1", "row_0", "row", "_row", "_n",
    "a.b",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i % 20} " * (i % 7 + 1), ["en", None][i % 2], f"src{i % 3}") for i in range(60)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return plain.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in NAMES])


def kept(rows):
    return all(row[n] == f"{n}:{row['doc_id']}" for row in rows for n in NAMES)


def test_interleave(docs):
    got, plain = interleave(docs, 4).collect(), interleave(docs.select("doc_id", "source"), 4).collect()
    assert kept(got) and len(got) == 60
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in plain}


def test_mix(docs):
    weights = [F.lit(1), F.lit(2)]
    got = mix(docs, ["lang", "source"], weights).collect()
    plain = mix(docs.select("doc_id", "text", "lang", "source"), ["lang", "source"], weights).collect()
    assert kept(got)
    assert sorted((r.doc_id, r.mix_epoch, r.mix_taken) for r in got) == sorted((r.doc_id, r.mix_epoch, r.mix_taken) for r in plain)


def test_without_copies(docs):
    got = without_copies(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert kept(rows) and len(rows) == len({r.text for r in docs.select("text").collect()})
