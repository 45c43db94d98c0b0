"""Exact duplicates by composable polynomial fingerprints.

A text's bytes are read as digits of a number in base ``b`` modulo a prime.
Chunks are hashed on their own, in any task; a chunk's hash counts shifted by
the bytes that follow it, so a text's fingerprint is a plain sum over its
chunks and any way of cutting gives the same. Texts of equal fingerprint and
length are then compared chunk by chunk; should they differ, a digest parts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertally.llm.registry import extended, query, table
from papertally.session import written

CHUNK_BYTES = 1 << 16
#: (prime, base); products of a byte, a power and the bytes of a chunk fit 63 bits.
FIELDS = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_019))


def chunk_hash(data: bytes, powers: list[np.ndarray]) -> list[int]:
    """The hashes of one chunk, one a field."""
    digits = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return [int((digits * p[: len(digits)][::-1]).sum()) % q for p, (q, _) in zip(powers, FIELDS)]


def power_tables(size: int = CHUNK_BYTES) -> list[np.ndarray]:
    """Powers of each field's base, from 0 to ``size`` - 1, by doubling."""
    tables = []
    for prime, base in FIELDS:
        known = np.ones(1, np.uint64)
        while len(known) < size:
            known = np.concatenate((known, known * np.uint64(pow(base, len(known), prime)) % np.uint64(prime)))
        tables.append(known[:size])
    return tables


def row_key() -> Column:
    """A row by what it holds: its doc_id (null unlike any number) and digest."""
    return _row_of(digest())


def _row_of(digest: Column | str) -> Column:
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), digest)


def digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def chunk_rows(docs: DataFrame, keep: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a chunk: the ``keep`` columns, ``chunk_no``, ``tail`` (bytes that
    follow the chunk in its text) and ``piece``. An empty text is one empty chunk."""
    sized = docs.withColumn("_bytes", F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    sized = sized.withColumn("_n", F.octet_length("_bytes").cast("bigint"))
    last = F.floor(F.greatest(F.col("_n") - 1, F.lit(0)) / chunk_bytes)
    cut = sized.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    begin = F.col("chunk_no") * chunk_bytes
    return cut.select(
        *keep,
        F.col("_n").alias("n_bytes"),
        "chunk_no",
        F.greatest(F.col("_n") - begin - chunk_bytes, F.lit(0)).cast("bigint").alias("tail"),
        F.substring("_bytes", (begin + 1).cast("int"), F.lit(chunk_bytes)).alias("piece"),
    )


def fingerprints(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``row_id``, ``doc_id``, ``text_sha256``, ``n_bytes``
    and ``fingerprint``. Null texts count as empty. ``row_id`` holds for this
    result only, so write it before reading it twice."""
    named = docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "text", digest().alias("text_sha256")
    )
    chunks = chunk_rows(named, ["row_id", "doc_id", "text_sha256"], chunk_bytes)
    fields = ["row_id", "doc_id", "text_sha256", "n_bytes"]
    schema = extended(chunks.select(*fields).schema, h0="bigint", h1="bigint")

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = power_tables(chunk_bytes)
        for batch in batches:
            sums: list[list[int]] = [[], []]
            for data, tail in zip(batch.column("piece").to_pylist(), batch.column("tail").to_pylist()):
                for k, h in enumerate(chunk_hash(data, powers)):
                    prime, base = FIELDS[k]
                    sums[k].append(h * pow(base, tail, prime) % prime if tail else h)
            columns = [batch.column(c) for c in fields] + [pa.array(s, pa.int64()) for s in sums]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    whole = chunks.mapInArrow(shifted, schema).groupBy(*fields)
    return whole.agg(
        (F.shiftleft(F.sum("h0") % FIELDS[0][0], 31) + F.sum("h1") % FIELDS[1][0]).alias("fingerprint")
    )


def unequal_groups(docs: DataFrame, marked: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The (``fingerprint``, ``n_bytes``) whose texts are not all the same bytes.

    Texts of groups of two or more meet chunk by chunk; a task hands on no more
    than the least and greatest chunk it has seen, so large groups stay cheap.
    """
    group = ["fingerprint", "n_bytes"]
    several = marked.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*group)
    wanted = marked.join(several, group, "left_semi").select(
        _row_of("text_sha256").alias("_key"),
        "fingerprint",
    ).distinct()
    texts = docs.select("text", row_key().alias("_key")).join(wanted, "_key")
    chunks = chunk_rows(texts, ["fingerprint"], chunk_bytes)
    compared = chunks.groupBy(*group, "chunk_no").agg(F.min("piece").alias("_a"), F.max("piece").alias("_b"))
    return compared.where("_a <> _b").select(*group).distinct()


def duplicate_groups(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``row_id``, ``doc_id``, ``keep_id`` (the
    largest doc_id with the same text), ``group_size``, ``kept``, ``text_sha256``.

    Null and empty texts are equal. Of rows that repeat a doc_id and its text
    exactly one is kept; a null doc_id is less than any other and is kept only
    if its group has no other. Other columns of ``docs`` are not read.
    """
    marked = written(fingerprints(docs, chunk_bytes))
    unequal = unequal_groups(docs, marked, chunk_bytes).withColumn("_unequal", F.lit(True))
    group = ["fingerprint", "n_bytes", "_part"]
    parted = marked.join(unequal, ["fingerprint", "n_bytes"], "left").withColumn(
        "_part", F.when(F.col("_unequal"), F.col("text_sha256")).otherwise(F.lit(""))
    )
    parted = written(parted.drop("_unequal"))
    best = parted.groupBy(*group).agg(
        F.max(F.struct("doc_id", "row_id")).alias("_keep"), F.count(F.lit(1)).alias("group_size")
    )
    return parted.join(best, group).select(
        "row_id",
        "doc_id",
        F.col("_keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("_keep.row_id")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with one row of each text: the one of the largest doc_id, with
    all its columns."""
    groups = duplicate_groups(docs, chunk_bytes).withColumn("row", _row_of("text_sha256"))
    return keep_rows(docs, groups.where("kept").select("row"), groups.select("row"))


def keep_rows(docs: DataFrame, kept: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is a ``row`` of ``kept``, each once.
    ``known`` has the ``row`` of every row of ``docs``."""
    own = next(n for n in (f"row_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    rows = docs.withColumn(own, row_key()).join(kept.select(F.col("row").alias(own)), own, "left_semi")
    # a whole row that is repeated is still there as often; most tables have none
    if not known.groupBy("row").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        rows = rows.dropDuplicates([own])
    return rows.select(*[rows[f"`{c}`"] for c in docs.columns])


@query(
    "op9_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_groups(table(spark, folder, "documents")).drop("row_id")
