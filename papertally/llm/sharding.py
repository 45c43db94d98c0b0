"""Shards that each match the mixture: proportional stratified interleaving.

Rows are shuffled by seed within their source and ranked; the rank over the
source's size is a row's place between 0 and 1. Sorted by that place and cut
into equal parts, every shard holds each source in its share, to one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertally.functions.positions import number_in_group
from papertally.llm.registry import query, table
from papertally.session import written

#: Rows wanted in a bucket, the largest share of a source that one task sorts.
BUCKET_ROWS = 64
#: Hex digits of the order key that make buckets: never more than 65,536 of them.
MAX_DIGITS = 4


def _digits(n_rows: int) -> int:
    digits = 2
    while digits < MAX_DIGITS and 16**digits * BUCKET_ROWS < n_rows:
        digits += 1
    return digits


def interleave(
    rows: DataFrame, shards: int, stratum: str = "source", ties: tuple[str, ...] = (), seed: str = "shard"
) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, without
    gaps in a shard). Shard sizes differ by one row at most.

    ``rows`` have ``doc_id`` and the ``stratum``, of which null is one of its
    own; a null doc_id has its own place. Rows of one doc_id are ordered by the
    ``ties`` columns; rows alike in these may change places. All columns stay,
    whatever their names; those named like the new ones are replaced, so pass
    narrow rows where texts aren't needed. Three writes and a count (actions).
    """
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    # under names of our own no column of the caller's meets one of the steps'
    own = [f"own_{i}" for i in range(len(names))]
    called = dict(zip(names, own))
    stratum, ties, doc_id = called[stratum], [called[t] for t in ties], F.col(called["doc_id"])
    rows = rows.select(*[rows[f"`{c}`"].alias(n) for c, n in called.items()])
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    keyed = written(rows.select(*own, key.alias("__shard_key")))
    total = keyed.count()
    digits = _digits(total)
    order = [F.col("__shard_key"), *[F.col(t) for t in ties]]
    ranked = number_in_group(keyed, [stratum], F.substring("__shard_key", 1, digits), order, "__shard_rank")
    sizes = keyed.groupBy(F.col(stratum).alias("__shard_stratum")).agg(F.count(F.lit(1)).alias("__shard_size"))
    placed = ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("__shard_stratum"))).withColumn(
        "__shard_place", (F.col("__shard_rank") - 0.5) / F.col("__shard_size")
    )
    placed = written(placed.drop("__shard_stratum", "__shard_rank", "__shard_size"))
    bucket = F.floor(F.col("__shard_place") * 16**digits)
    lined = number_in_group(placed, [], bucket, [F.col("__shard_place"), F.col(stratum), *order], "_at")
    at = F.col("_at") - 1
    shard = F.floor(F.expr(f"((_at - 1) * {shards}) div {max(total, 1)}"))
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return lined.withColumn("shard", shard.cast("int")).select(
        *[F.col(n).alias(c) for c, n in called.items()], "shard", (at - first).cast("bigint").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int, stratum: str = "source", seed: str = "shard") -> None:
    """Write whole ``docs`` as one folder a shard, rows in the order of slots."""
    lined = interleave(docs, shards, stratum, seed=seed)
    ordered = lined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def text_crc32() -> Column:
    return F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))


SHARDS = 16
SQL = f"""
    WITH d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, text,
                      md5('shard:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
    p AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS place FROM d),
    l AS (SELECT *, row_number() OVER (ORDER BY place, source, key) - 1 AS spot, count(*) OVER () AS total FROM p),
    s AS (SELECT *, (spot * {SHARDS}) // total AS shard FROM l)
    SELECT doc_id, source, size, 'rows' AS law, shard::INT AS shard, (spot - (shard * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot,
           NULL::INTEGER AS grown_shard FROM s"""


@query("op7_sharding")
def sharding(spark: SparkSession, folder: str) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint") + 1
    rows = table(spark, folder, "documents").select(
        "doc_id", "source", size.alias("size"), text_crc32().alias("text_crc32")
    )
    return interleave(rows, SHARDS, ties=("text_crc32", "size")).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
