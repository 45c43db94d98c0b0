"""The review screen: queue, titles, feedback, corrections, resolution trail."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertally.config import literal_map
from papertally.functions.dates import relative_day
from papertally.functions.positions import keep_last, top_rows
from papertally.operators.quality import FieldSpec, filled

# Sizes of the queue and of feedback entries.
QUEUE_LIMIT = 100
TITLE_LENGTH = 40
FIELD_LENGTH = 140
VALUE_LENGTH = 500
ADDED_LIMIT = 40

REFERENCE = ["reference_doctype", "reference_name", "reference_detail"]


def _newest(*more: str) -> list[Column]:
    return [F.col("creation").desc(), *[F.col(c).desc() for c in more]]


def latest_per_reference(runs: DataFrame, scan_limit: int | None = None) -> DataFrame:
    """Newest run of each reference; with ``scan_limit`` among that many newest
    runs, which are cut before the de-duplication."""
    rows = runs if scan_limit is None else runs.orderBy(*_newest("name")).limit(scan_limit)
    return keep_last(rows, REFERENCE, F.struct("creation", "name"))


def without_newer_resolved(runs: DataFrame, every_run: DataFrame) -> DataFrame:
    """Drop runs whose reference has a later ``Completed`` run.

    Only the latest completed run of a reference matters, so that table is
    reduced to one row per reference before the join.
    """
    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    done = (
        every_run.where(F.col("status") == "Completed")
        .groupBy(*[blank(c).alias(f"_{c}") for c in REFERENCE])
        .agg(F.max("creation").alias("_last"))
    )
    same = [blank(c) == F.col(f"_{c}") for c in REFERENCE]
    condition = same[0] & same[1] & same[2] & (F.col("_last") > F.col("creation"))
    return runs.join(done, condition, "left_anti")


def document_titles(items: DataFrame, schema: Sequence[FieldSpec]) -> DataFrame:
    """(doc, title): the value of the first title key, else the first value."""
    titles = [s.key for s in schema if s.is_title]
    place = F.element_at(literal_map({s.key: i for i, s in enumerate(schema)}), F.col("key"))
    first = F.coalesce("idx", F.lit(0))
    titled = F.col("key").isin(titles) & (first == 0) if titles else F.lit(False)
    order = F.struct((~titled).alias("t"), place.alias("k"), first.alias("i"), "value")
    return items.where(filled(F.col("value"))).groupBy("doc").agg(
        F.substring(F.min_by("value", order), 1, TITLE_LENGTH).alias("title")
    )


def review_queue(
    runs: DataFrame,
    titles: DataFrame | None = None,
    action: str | None = None,
    scan_limit: int | None = None,
) -> DataFrame:
    """Runs that wait for a human: the newest of each reference, unless a later
    run resolved it. ``titles``: (doc = run name, title)."""
    waiting = runs.where((F.col("status") == "Needs Review") & (F.col("reference_name") != ""))
    if action:
        waiting = waiting.where(F.col("action") == action)
    queue = without_newer_resolved(latest_per_reference(waiting, scan_limit), runs)
    own = F.lit(None).cast("string")
    if titles is not None:
        queue = queue.join(titles.withColumnRenamed("doc", "name"), "name", "left")
        own = F.col("title")
    blank = F.lit("")
    title = F.coalesce(
        F.nullif(own, blank), F.nullif(F.col("reference_detail"), blank), F.nullif(F.col("reference_name"), blank), F.col("name").cast("string")
    )
    return queue.withColumn("title", title)


def _refused(value: Column) -> Column:
    """Why feedback with this value is not accepted; null if it is."""
    return (
        F.when(~filled(F.col("field")) | (F.length("field") > FIELD_LENGTH), "field")
        .when(F.col("verdict").isin("corrected", "added") & (F.length(value) > VALUE_LENGTH), "value")
        .when((F.col("verdict") == "added") & (F.length(value) == 0), "value")
        .when(~F.col("verdict").isin("correct", "wrong", "corrected", "clear", "added"), "verdict")
    )


def _given() -> Column:
    text = F.coalesce("value", F.lit(""))
    return F.when(F.col("verdict") == "added", F.trim(text)).otherwise(text)


def rejected_feedback(events: DataFrame) -> DataFrame:
    """Events (as in :func:`last_feedback`, or ``added``) that count nowhere,
    with the ``refused`` part: ``field``, ``value`` or ``verdict``."""
    verdict = F.when(F.col("verdict").isNull(), "verdict")
    return events.withColumn("refused", F.coalesce(_refused(_given()), verdict)).where(F.col("refused").isNotNull())


def feedback_fold(events: DataFrame) -> DataFrame:
    """(doc, field, idx, verdict, value, by, at): the verdict that stands.

    ``events`` as in :func:`last_feedback`; its results may be given again.
    """
    return last_feedback(events).where(F.col("verdict") != "clear").drop("seq")


def last_feedback(events: DataFrame) -> DataFrame:
    """(doc, field, idx, verdict, value, by, at, seq): the last verdict given,
    ``clear`` too.

    ``events``: (doc, field, idx, verdict, value, by, at, seq) with verdicts
    ``correct``, ``wrong``, ``corrected`` or ``clear``; the last one per field
    and index counts, and ``clear`` removes it. ``seq`` orders equal times.
    Events that :func:`rejected_feedback` gives do not count.
    """
    valid = events.where(F.col("verdict").isin("correct", "wrong", "corrected", "clear") & _refused(_given()).isNull())
    value = F.when(F.col("verdict") == "corrected", F.coalesce("value", F.lit("")))
    last = (
        valid.withColumn("value", value)
        .groupBy("doc", "field", "idx")
        .agg(F.max_by(F.struct("verdict", "value", "by", "at", "seq"), F.struct("at", "seq")).alias("_f"))
    )
    return last.select("doc", "field", "idx", "_f.*")


def added_values(events: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc, field, value, by, at, pos): values a reviewer added; with ``limit``
    (such as ``ADDED_LIMIT``) the first ones of each document."""
    valid = events.where((F.col("verdict") == "added") & _refused(_given()).isNull()).withColumn("value", _given())
    return top_rows(valid, ["doc"], [F.col("at"), F.col("seq")], limit, "pos").select(
        "doc", "field", "value", "by", "at", "pos"
    )


def overlay_corrections(
    items: DataFrame, folded: DataFrame, added: DataFrame, schema: Sequence[FieldSpec]
) -> DataFrame:
    """Items as corrected by the reviewer.

    A corrected value replaces the one at (key, idx); for a single-valued key it
    replaces the only item whatever the index, and creates it if it is missing
    and no index was given; an index outside the list is skipped.
    Added values follow the items of their list, in the order they were added.
    """
    lists = [s.key for s in schema if s.kind == "array"]
    fixes = folded.where(F.col("verdict") == "corrected").select(
        "doc", F.col("field").alias("key"), F.coalesce("idx", F.lit(-1)).alias("_given"), "value", "at"
    )
    scalar_fix = ~F.col("key").isin(lists)
    fixes = (
        fixes.where(scalar_fix | (F.col("_given") >= 0))
        .withColumn("_i", F.when(scalar_fix, F.lit(-1)).otherwise(F.col("_given")))
        .groupBy("doc", "key", "_i")
        .agg(F.max_by("value", "at").alias("_fix"), F.expr("max_by(value, at) FILTER (WHERE _given = -1)").alias("_new"))
    )
    old = items.withColumn("_i", F.coalesce("idx", F.lit(-1))).withColumn("_old", F.lit(True))
    joined = old.join(fixes, ["doc", "key", "_i"], "full").where(
        F.col("_old") | (~F.col("key").isin(lists) & F.col("_new").isNotNull())
    )
    fixed = joined.select(
        "doc",
        "key",
        F.when(F.col("_i") >= 0, F.col("_i")).cast("int").alias("idx"),
        F.when(F.col("_old").isNull(), F.col("_new")).otherwise(F.coalesce("_fix", "value")).alias("value"),
        F.when(F.col("_old").isNull(), F.col("_new")).otherwise(F.col("raw_text")).alias("raw_text"),
        F.when(F.col("_fix").isNotNull(), "corrected").otherwise("model").alias("origin"),
    )
    sizes = items.where(F.col("key").isin(lists)).groupBy("doc", "key").agg(F.count(F.lit(1)).alias("_len"))
    # a person adds these values one by one, so a document has few to number
    w = Window.partitionBy("doc", "key").orderBy("pos")
    more = (
        added.withColumnRenamed("field", "key")
        .where(F.col("key").isin(lists))
        .withColumn("_n", F.row_number().over(w))
        .join(sizes, ["doc", "key"], "left")
        .select(
            "doc",
            "key",
            (F.coalesce("_len", F.lit(0)) + F.col("_n") - 1).cast("int").alias("idx"),
            "value",
            F.col("value").alias("raw_text"),
            F.lit("added").alias("origin"),
        )
    )
    return fixed.unionByName(more)


def model_values(feedback: DataFrame, items: DataFrame) -> DataFrame:
    """Feedback with ``model_value``: what the model gave at (field, idx), for a
    single-valued field whatever the index; null outside the list or for a list
    without an index."""
    named = items.select("doc", F.col("key").alias("field"), F.col("idx").alias("_at"), "value")
    single = named.where("_at IS NULL").select("doc", "field", F.col("value").alias("_single"))
    listed = named.where("_at IS NOT NULL").select("doc", "field", F.col("_at").alias("_i"), F.col("value").alias("_listed"))
    asked = feedback.withColumn("_i", F.col("idx"))
    found = asked.join(single, ["doc", "field"], "left").join(listed, ["doc", "field", "_i"], "left")
    return found.withColumn("model_value", F.coalesce("_listed", "_single")).drop("_i", "_single", "_listed")


def resolution_trail(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs after human resolutions.

    ``events``: (run, kind, ok, complete, at) with kind ``finalize``,
    ``escalate`` or ``close``. A successful finalising event that is not kept
    open, or a close, completes a run that needs review.
    """
    done = F.coalesce("ok", F.lit(False)) & (F.col("kind") == "finalize") & F.coalesce("complete", F.lit(True))
    closed = events.groupBy("run").agg(
        F.bool_or(done | (F.col("kind") == "close")).alias("_closed"), F.count(F.lit(1)).alias("n_resolutions")
    )
    joined = runs.join(closed, runs["name"] == closed["run"], "left").drop("run")
    finished = (F.col("status") == "Needs Review") & F.coalesce("_closed", F.lit(False))
    return joined.withColumn("status", F.when(finished, "Completed").otherwise(F.col("status"))).withColumn(
        "n_resolutions", F.coalesce("n_resolutions", F.lit(0))
    ).drop("_closed")


def review_context(runs: DataFrame, offsets: Mapping[str, str], saved: DataFrame | None = None) -> DataFrame:
    """(doc, <keys>): the look-up window of each run.

    The run's own saved context (``saved``: doc, <keys>) wins as a whole; else
    the configured offsets apply to the day the run was created.
    """
    base = F.col("creation").cast("date")
    rows = runs.select(
        F.col("name").alias("doc"), *[relative_day(base, F.lit(str(o))).alias(k) for k, o in offsets.items()]
    )
    if saved is None:
        return rows
    own = saved.select("doc", F.lit(True).alias("_own"), *[F.col(k).cast("string").alias(f"_{k}") for k in offsets])
    return rows.join(own, "doc", "left").select(
        "doc", *[F.when(F.col("_own"), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in offsets]
    )


def runs_to_fill(runs: DataFrame, stored_matches: DataFrame) -> DataFrame:
    """Runs in review without stored matches: those that get live candidates."""
    have = stored_matches.select(F.col("doc").alias("name")).distinct()
    return runs.where(F.col("status") == "Needs Review").join(have, "name", "left_anti")
