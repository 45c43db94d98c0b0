"""Token ids as Parquet list columns.

Files hold documents in ascending id, one row a document: its metadata, its
number of ids and a list of ids. Ids are dictionary-encoded (a vocabulary fits
one dictionary page, so an id takes as many bits as the vocabulary needs), row
groups and pages are small and carry the page indexes that the writer adds, so
a reader of a few documents, or of metadata alone, touches few pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papertally.llm.registry import extended, query, table
from papertally.llm.tokens import END, default_tokenizer, encoder
from papertally.session import shared_path

#: How the files are written; a page of ids is the least that is read.
FORMAT = {
    "compression": "zstd",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "5000",
}
#: Rows that a task hands on at a time.
STEP = 500


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    metadata: Sequence[str] = (),
) -> None:
    """Write the ids of all ``docs`` (``doc_id``, ``text``) to ``path``.

    Columns: ``doc_id``, the ``metadata`` columns, ``shard`` (the number of the
    file), ``start_in_shard`` (ids before the document in its file),
    ``n_tokens`` and ``token_ids``. A null or empty text has the end id alone.
    Rows of one doc_id stay, ordered by text; a null doc_id comes first. Other
    columns are not read; a metadata column may not have one of the names above.
    """
    tokenizer = tokenizer or default_tokenizer()
    clash = {"doc_id", "text", "shard", "start_in_shard", "n_tokens", "token_ids"} & {*metadata}
    if clash:
        raise ValueError(f"metadata columns with names of the format: {sorted(clash)}")
    order = ["doc_id", F.xxhash64("text")]
    ordered = (
        docs.select("doc_id", "text", *metadata).repartitionByRange(*order).sortWithinPartitions(*order)
    )
    kept = ordered.select("doc_id", *metadata).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = encoder(tokenizer), 0
        shard = TaskContext.get().partitionId()
        for whole in batches:
            for k in range(0, whole.num_rows, STEP):
                batch = whole.slice(k, STEP)
                ids = [words.encode(t) + END for t in batch.column("text").to_pylist()]
                sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                ends = np.concatenate(([0], np.cumsum(sizes)))
                tokens = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in kept.names],
                        pa.array(np.full(len(ids), shard, np.int32)),
                        pa.array(start + ends[:-1]),
                        pa.array(sizes),
                        tokens,
                    ],
                    names=[*kept.names, "shard", "start_in_shard", "n_tokens", "token_ids"],
                )
                start += int(ends[-1])

    schema = extended(
        kept, shard="int", start_in_shard="bigint", n_tokens="bigint", token_ids="array<int>"
    )
    ordered.mapInArrow(encode, schema).write.options(**FORMAT).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Where each document's ids are, from the small columns alone: all columns
    but the ids, and ``start``, the ids of all documents before it."""
    rows = spark.read.parquet(path).drop("token_ids")
    return _started(rows, rows)


def _started(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("_ids"))
    starts = shards.select("shard", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    return rows.join(starts, "shard").withColumn("start", F.col("_before") + F.col("start_in_shard")).drop("_before")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens`` and the
    unsigned ``ids_crc32`` of its ids."""
    stored = spark.read.parquet(path)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("token_ids")
            ends = lists.offsets.to_numpy()
            ids = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["shard", "doc_id", "start_in_shard", "n_tokens", "ids_crc32"],
            )

    rows = stored.select("shard", "doc_id", "start_in_shard", "token_ids")
    schema = extended(rows.drop("token_ids").schema, n_tokens="bigint", ids_crc32="bigint")
    return _started(rows.mapInArrow(check, schema), stored.select("shard", "n_tokens")).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


@query("op1_token_binary")
def token_binary(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark)
    write_tokens(table(spark, folder, "documents"), path, metadata=["lang", "source"])
    return read_checksums(spark, path)
