"""Positions inside groups that may be of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_in_group(
    df: DataFrame,
    group: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str,
) -> DataFrame:
    """Add the 1-based position of each row in its group.

    A plain ``row_number`` sorts a whole group in one task. Here ``bucket`` cuts
    the group into consecutive ranges of the order (it must never decrease along
    ``order``): rows are numbered inside a bucket, and the sizes of the earlier
    buckets, a small table, are added. No task sees more than one bucket.
    """
    keys = list(group)
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = tagged.withColumn("_inner", F.row_number().over(inside))
    left, right = numbered.alias("n"), offsets.alias("o")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "_bucket"]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return left.join(right, condition).select(
        *[F.col(f"n.{c}").alias(c) for c in df.columns],
        (F.col("o._offset") + F.col("n._inner")).cast("bigint").alias(out),
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the one with the smallest ``order`` (a unique struct).

    An aggregate, not a window: each task reduces its rows before the shuffle,
    so a key holding most of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), order)
    return df.groupBy(*keys).agg(best.alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in rest]
    ).select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the one with the largest ``order`` (a unique struct)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), order)
    return df.groupBy(*keys).agg(best.alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in rest]
    ).select(*df.columns)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, out: str) -> DataFrame:
    """The first ``k`` rows per key with their rank (``None``: all rows).

    Spark cuts each task's rows to ``k`` per key before the shuffle
    (``WindowGroupLimit``), so large groups never travel whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(out, F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col(out) <= k)
