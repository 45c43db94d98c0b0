"""Scanned pages: classification rows, sections, numbering, versions, purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertally.functions.numbers import try_double
from papertally.functions.positions import keep_first, number_in_group
from papertally.functions.ratio import length_bound, letter_bound, letter_set_bound, matching_blocks_ratio
from papertally.functions.text import blank_to_null
from papertally.session import written

# Label snapping, default layout, retention of preview files.
LABEL_CUTOFF = 0.8
UNKNOWN = "unknown"
DEFAULT_LAYOUT_TYPE = "Single Page"
PREVIEW_PATTERN = "Data_Builder_Preview_%"
PREVIEW_MINUTES = 15


def snap_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (layout, section, ...) with ``section`` snapped to an allowed label.

    Equal ignoring case first, by an equi-join. Distinct leftovers meet the
    layout's labels of a length that can reach 0.8, and go through the ratio if
    their letters can, too: the closest label counts, the larger text among
    equals. What was found is written once (an action), so that each pair is
    compared once. ``labels``: (layout, label); later duplicates that differ in
    case win, as in a lookup table filled in order (``pos``).
    """
    text = F.trim(F.coalesce("section", F.lit("")))
    cleaned = rows.withColumn("_s", text).withColumn("_low", F.lower("_s"))
    by_case = labels.groupBy("layout", F.lower("label").alias("_low")).agg(F.max_by("label", "pos").alias("_exact"))
    known = cleaned.join(by_case, ["layout", "_low"], "left")
    asked = (
        known.where(F.col("_exact").isNull() & (F.col("_s") != "") & (F.col("_low") != UNKNOWN))
        .select("layout", "_s")
        .distinct()
    )
    # 2 * shorter / (both) reaches the cutoff for these lengths only
    reach = (2 - LABEL_CUTOFF) / LABEL_CUTOFF
    size = F.length("_s")
    lengths = F.sequence(F.floor(size / reach).cast("int"), F.ceil(size * reach).cast("int"))
    sized = labels.select("layout", "label", F.length("label").alias("_len")).distinct()
    close = asked.withColumn("_len", F.explode(lengths)).join(sized, ["layout", "_len"])
    for bound in (length_bound, letter_set_bound, letter_bound):
        close = close.where(bound(F.col("label"), F.col("_s")) >= LABEL_CUTOFF)
    scored = close.withColumn("_ratio", matching_blocks_ratio(F.col("label"), F.col("_s"))).where(
        F.col("_ratio") >= LABEL_CUTOFF
    )
    best = written(scored.groupBy("layout", "_s").agg(F.max(F.struct("_ratio", "label")).alias("_best")))
    return (
        known.join(best, ["layout", "_s"], "left")
        .withColumn("section", F.coalesce("_exact", "_best.label", F.lit(UNKNOWN)))
        .select(*rows.columns)
    )


def page_rows(answers: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Exactly one row per page 1..n of each document.

    ``answers``: (doc, pos, page as text, section, page_type, confidence as
    text); ``documents``: (doc, layout, n_pages). The first answer of a page
    counts, pages out of range are dropped, missing ones are ``unknown`` /
    ``Front`` / 0.
    """
    number = F.regexp_extract(F.trim(F.col("page").cast("string")), r"\A([+-]?[0-9]+)(?:\.[0-9]*)?\z", 1)
    numbered = answers.withColumn("page", blank_to_null(number).try_cast("int")).where(F.col("page").isNotNull())
    inside = (
        numbered.join(documents, "doc")
        .where(F.col("page").between(F.lit(1), F.col("n_pages")))
        .select("doc", "page", "layout", "pos", "section", "page_type", "confidence")
    )
    first = keep_first(inside, ["doc", "page"], F.struct("pos", "section", "page_type", "confidence"))
    side = F.initcap(F.trim(F.coalesce(blank_to_null(F.col("page_type")), F.lit("Front"))))
    score = F.coalesce(F.least(F.greatest(try_double(F.col("confidence")), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    given = snap_labels(first, labels).select(
        "doc",
        "page",
        "section",
        F.when(side.isin("Front", "Back"), side).otherwise("Front").alias("page_type"),
        score.alias("confidence"),
    )
    every = documents.where(F.col("n_pages") > 0).select("doc", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page"))
    return every.join(given, ["doc", "page"], "left").select(
        "doc",
        "page",
        F.coalesce("section", F.lit(UNKNOWN)).alias("section"),
        F.coalesce("page_type", F.lit("Front")).alias("page_type"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def section_layout(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Rows (layout, section, ...) with a real section and its layout type.

    ``sections``: (layout, pos, title, layout_type). An unknown label becomes
    the layout's first section; a missing type becomes the first section's type
    or ``Single Page``.
    """
    types = sections.groupBy("layout", "title").agg(F.max_by("layout_type", "pos").alias("_type"))
    first = sections.groupBy("layout").agg(
        F.min_by(F.struct("title", "layout_type"), F.struct("pos", "title")).alias("_first")
    )
    known = types.select("layout", F.col("title").alias("section"), F.lit(True).alias("_known"))
    joined = rows.join(first, "layout").join(known, ["layout", "section"], "left")
    real = joined.withColumn("section", F.when(F.col("_known"), F.col("section")).otherwise(F.col("_first.title")))
    default = F.coalesce(blank_to_null(F.col("_first.layout_type")), F.lit(DEFAULT_LAYOUT_TYPE))
    return (
        real.join(types.withColumnRenamed("title", "section"), ["layout", "section"], "left")
        .withColumn("layout_type", F.coalesce("_type", default))
        .select(*rows.columns, "layout_type")
    )


def align_pages(details: DataFrame, results: DataFrame) -> DataFrame:
    """Live pages of a scan, in page order, with the result of the same place.

    ``details``: (scan, name, page_no, is_deleted); ``results``: (scan, page,
    section, page_type, confidence). Pages beyond the results get the defaults.
    """
    live = details.where(F.col("is_deleted") == 0)
    placed = number_in_group(
        live.select("scan", "name", "page_no"),
        ["scan"],
        F.floor(F.col("page_no") / 4096),
        [F.col("page_no"), F.col("name")],
        "page",
    )
    return placed.join(results, ["scan", "page"], "left").select(
        "scan",
        "name",
        "page_no",
        F.coalesce("section", F.lit(UNKNOWN)).alias("section"),
        F.coalesce("page_type", F.lit("Front")).alias("page_type"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def section_pages(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages under their section, one row each; a section without pages keeps
    one row with no page. ``sections``: (scan, pos, title, layout_type)."""
    images = pages.select("scan", F.col("title"), "page_no", "attachment", "page_type")
    return sections.join(images, ["scan", "title"], "left")


def dense_page_numbers(pages: DataFrame, bucket: int = 4096) -> DataFrame:
    """Pages (scan, section, page_no, pos) renumbered 1, 2, 3 ... per section in
    the order in which their numbers first appear."""
    firsts = pages.groupBy("scan", "section", "page_no").agg(F.min("pos").alias("_first"))
    dense = number_in_group(firsts, ["scan", "section"], F.floor(F.col("_first") / bucket), [F.col("_first")], "new_page_no")
    joined = pages.join(dense.drop("_first"), ["scan", "section", "page_no"])
    return joined.select(*pages.columns, "new_page_no")


def next_page(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(scan, section, page_no): where a newly scanned page goes.

    The first ``Series Vertical`` section, else the first section; after its
    highest page number. ``sections``: (scan, pos, title, layout_type).
    """
    series = F.coalesce(F.col("layout_type") == "Series Vertical", F.lit(False))
    target = sections.groupBy("scan").agg(F.min_by("title", F.struct((~series).alias("o"), "pos")).alias("section"))
    last = pages.groupBy("scan", F.col("title").alias("section")).agg(F.max("page_no").alias("_max"))
    return target.join(last, ["scan", "section"], "left").select(
        "scan", "section", (F.greatest(F.coalesce("_max", F.lit(0)), F.lit(0)) + 1).alias("page_no")
    )


def replace_scan(details: DataFrame, saved: DataFrame, listed: DataFrame) -> DataFrame:
    """Page details after scans were saved again.

    ``saved``: (scan); ``listed``: (scan, name) pages of the new version. All
    pages of a saved scan are deleted softly, then the listed ones are revived
    and moved to the scan.
    """
    renewed = saved.select(F.col("scan").alias("scanner_document")).distinct().withColumn("_saved", F.lit(True))
    wanted = listed.groupBy("name").agg(F.max("scan").alias("_scan"))
    joined = details.join(renewed, "scanner_document", "left").join(wanted, "name", "left")
    replaced = {
        "is_deleted": F.when(F.col("_scan").isNotNull(), 0).when(F.col("_saved"), 1).otherwise(F.col("is_deleted")),
        "scanner_document": F.coalesce("_scan", "scanner_document"),
    }
    return joined.select(*[replaced.get(c, F.col(c)).alias(c) for c in details.columns])


def without_deleted(details: DataFrame) -> DataFrame:
    """Pages left after the purge of softly deleted ones."""
    return details.where(F.coalesce("is_deleted", F.lit(0)) != 1)


def expired_previews(now: Column, minutes: int = PREVIEW_MINUTES) -> Column:
    """Condition: a private preview file older than the retention time. The
    underscores of the pattern stand for any character."""
    old = F.col("creation") < now - F.expr(f"INTERVAL {minutes} MINUTES")
    hit = F.col("file_name").like(PREVIEW_PATTERN) & (F.col("is_private") == 1) & old
    return F.coalesce(hit, F.lit(False))


def without_expired_previews(files: DataFrame, now: Column, minutes: int = PREVIEW_MINUTES) -> DataFrame:
    return files.where(~expired_previews(now, minutes))
