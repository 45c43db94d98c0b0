"""Learned supplier-to-item mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertally.functions.text import blank_to_null, text_key

SCOPE = ["supplier", "source_system", "target_doctype"]


def lookup_mappings(lines: DataFrame, mappings: DataFrame, items: DataFrame) -> DataFrame:
    """Lines with the remembered ``item_code``, ``item_uom`` and ``tier``.

    Within (supplier, system, target) the exact supplier code is tried, then
    the exact text key. Of each only the mapping with most hits counts; if its
    item is gone, the text tier is tried, never the runner-up.

    ``lines``: (..., supplier, source_system, target_doctype, text, code).
    """
    alive = items.select(F.col("item_code").alias("_item")).distinct()

    def winners(key: str, out: str) -> DataFrame:
        best = F.max_by(F.struct("item_code", "uom"), F.struct("hit_count", "name"))
        top = (
            mappings.where(F.coalesce(key, F.lit("")) != "")
            .groupBy(*SCOPE, F.col(key).alias("_key"))
            .agg(best.alias("_best"))
            .select(*SCOPE, F.col("_key"), F.col("_best.item_code").alias("_item"), F.col("_best.uom").alias("_uom"))
        )
        found = top.join(alive, "_item", "left_semi")
        return found.select(*SCOPE, F.col("_key").alias(f"_{out}_key"), F.struct("_item", "_uom").alias(f"_{out}"))

    keyed = lines.withColumn("_code_key", blank_to_null(F.col("code"))).withColumn(
        "_text_key", blank_to_null(text_key(F.col("text")))
    )
    joined = keyed.join(winners("supplier_code", "code"), [*SCOPE, "_code_key"], "left").join(
        winners("normalized_text", "text"), [*SCOPE, "_text_key"], "left"
    )
    hit = F.coalesce("_code", "_text")
    tier = F.when(F.col("_code").isNotNull(), "code").when(F.col("_text").isNotNull(), "text")
    return joined.select(
        *lines.columns, hit["_item"].alias("item_code"), hit["_uom"].alias("item_uom"), tier.alias("tier")
    )


def upsert_mappings(mappings: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Mapping table after confirmations (supplier, source_system,
    target_doctype, item_code, printed_text, code, uom, at).

    A known (scope, text key, item) gains one hit per confirmation and the time
    of the last; its code is filled only if empty. A new one starts with the
    first confirmation's unit and text. Confirmations without supplier or item
    are ignored. One aggregate over both tables does all of it.
    """
    keys = [*SCOPE, "normalized_text", "item_code"]
    known = mappings.select(
        *keys,
        F.lit(0).alias("_new"),
        F.col("hit_count").cast("bigint").alias("hits"),
        F.col("last_used").alias("at"),
        "printed_text",
        blank_to_null(F.col("supplier_code")).alias("code"),
        "uom",
        F.col("confidence").cast("double").alias("confidence"),
    )
    fresh = confirmations.where(
        (F.coalesce("supplier", F.lit("")) != "")
        & (F.coalesce(F.col("item_code").cast("string"), F.lit("")) != "")
    ).select(
        *SCOPE,
        text_key(F.col("printed_text")).alias("normalized_text"),
        "item_code",
        F.lit(1).alias("_new"),
        F.lit(1).cast("bigint").alias("hits"),
        "at",
        "printed_text",
        blank_to_null(F.col("code")).alias("code"),
        "uom",
        F.lit(1.0).alias("confidence"),
    )
    order = F.struct("_new", "at", "printed_text", "code", "uom")
    first = F.min_by(F.struct("printed_text", "uom", "confidence"), order)
    return (
        known.unionByName(fresh)
        .groupBy(*keys)
        .agg(
            F.sum("hits").alias("hit_count"),
            F.max("at").alias("last_used"),
            F.min_by("code", F.when(F.col("code").isNotNull(), order)).alias("supplier_code"),
            first.alias("_first"),
        )
        .select(
            *keys,
            F.col("_first.printed_text").alias("printed_text"),
            "supplier_code",
            F.col("_first.uom").alias("uom"),
            "hit_count",
            F.col("_first.confidence").alias("confidence"),
            "last_used",
        )
    )


def stale_vectors(texts: DataFrame, vectors: DataFrame, text: Column) -> DataFrame:
    """(item, text_hash): items without a vector, or whose text has changed.

    ``texts``: (item, ...) with ``text`` an expression over it; ``vectors``:
    (item, text_hash, has_vector).
    """
    hashed = texts.select("item", F.sha1(F.coalesce(text, F.lit(""))).alias("text_hash"))
    stored = vectors.select("item", F.col("text_hash").alias("_stored"), "has_vector")
    joined = hashed.join(stored, "item", "left")
    current = F.coalesce((F.col("_stored") == F.col("text_hash")) & F.col("has_vector"), F.lit(False))
    return joined.where(~current).select("item", "text_hash")
