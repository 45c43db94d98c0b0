"""Scanned pages. A conversation is a scan: its turns are pages, its roles the
sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertally.catalog.registry import Tables, query
from papertally.config import config_frame
from papertally.operators import pages as G


def _layout(t: Tables) -> DataFrame:
    rows = [("L", 0, "User", "Single Page"), ("L", 1, "Assistant", "Series Vertical"), ("L", 2, "Notes", None)]
    return config_frame(t.spark, rows, "layout string, pos int, title string, layout_type string")


def _labels(t: Tables) -> DataFrame:
    return _layout(t).select("layout", "pos", F.col("title").alias("label"))


def _answers(t: Tables, section: str) -> DataFrame:
    """One answer per turn; every third page is left out, turn 0 is out of range."""
    return t.conversations.where(F.col("turn") % 3 != 2).select(
        F.col("conv_id").alias("doc"),
        F.col("turn").alias("pos"),
        F.when(F.col("turn") == 4, F.lit("1")).otherwise(F.col("turn").cast("string")).alias("page"),
        F.expr(section).alias("section"),
        F.when(F.col("turn") % 2 == 0, " back ").otherwise("side").alias("page_type"),
        F.when(F.col("turn") == 1, F.lit("1.7")).otherwise("0.25").alias("confidence"),
    )


def _scans(t: Tables) -> DataFrame:
    return t.conversations.groupBy(F.col("conv_id").alias("doc")).agg(F.max("turn").cast("int").alias("n_pages")).withColumn("layout", F.lit("L"))


_PAGE_ROWS = """
    WITH scans AS (SELECT conv_id AS doc, max(turn) AS n FROM conversations GROUP BY 1),
    every AS (SELECT doc, CAST(unnest(range(1, n + 1)) AS INTEGER) AS page FROM scans WHERE n > 0),
    given AS (SELECT conv_id AS doc, CASE turn WHEN 4 THEN 1 ELSE turn END AS page, min(turn) AS pos, arg_min(role, turn) AS role
              FROM conversations WHERE turn % 3 <> 2 GROUP BY 1, 2)
    SELECT e.doc, e.page, CASE g.role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'unknown' END AS section,
           CASE WHEN g.pos % 2 = 0 THEN 'Back' ELSE 'Front' END AS page_type,
           CASE WHEN g.pos IS NULL THEN 0.0::DOUBLE WHEN g.pos = 1 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS confidence
    FROM every e LEFT JOIN given g ON g.doc = e.doc AND g.page = e.page
    """


@query("page_rows_gapfill", _PAGE_ROWS)
def page_rows_gapfill(t: Tables) -> DataFrame:
    return G.page_rows(_answers(t, "upper(role)"), _scans(t), _labels(t))


@query("page_rows_fuzzy", _PAGE_ROWS)
def page_rows_fuzzy(t: Tables) -> DataFrame:
    """Labels with a letter too many: the ratio, 2n/(2n + 1), snaps them back."""
    return G.page_rows(_answers(t, "concat(initcap(role), ':')"), _scans(t), _labels(t))


@query(
    "section_lookup",
    """
    SELECT conv_id AS scan, turn, CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'User' END AS section,
           CASE role WHEN 'assistant' THEN 'Series Vertical' ELSE 'Single Page' END AS layout_type
    FROM conversations
    """,
)
def section_lookup(t: Tables) -> DataFrame:
    rows = t.conversations.select(
        F.lit("L").alias("layout"), F.col("conv_id").alias("scan"), "turn", F.initcap("role").alias("section")
    )
    return G.section_layout(rows, _layout(t)).select("scan", "turn", "section", "layout_type")


def _scan_pages(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.col("conv_id").alias("scan"),
        F.initcap("role").alias("title"),
        F.col("turn").cast("int").alias("page_no"),
        F.length("text").alias("attachment"),
        F.lit("Front").alias("page_type"),
    )


def _scan_sections(t: Tables) -> DataFrame:
    # the layout is a table of three rows
    entries = [("User", 0, "Single Page"), ("Assistant", 1, "Series Vertical"), ("Notes", 2, None)]
    listed = F.expr("array(" + ", ".join(f"struct('{n}' AS title, {p} AS pos, {repr(k) if k else 'NULL'} AS layout_type)" for n, p, k in entries) + ")")
    return t.conversations.select(F.col("conv_id").alias("scan")).distinct().select("scan", F.inline(listed))


_SECTIONS = """
    sections AS (
      SELECT scan, title, pos, kind FROM (SELECT DISTINCT conv_id AS scan FROM conversations) s,
             (VALUES ('User', 0, 'Single Page'), ('Assistant', 1, 'Series Vertical'), ('Notes', 2, NULL)) v(title, pos, kind)),
    pages AS (SELECT conv_id AS scan, upper(role[1]) || role[2:] AS title, CAST(turn AS INTEGER) AS page_no, length(text) AS attachment FROM conversations)
    """


@query(
    "section_pages",
    "WITH" + _SECTIONS + """
    SELECT s.scan, s.title, s.pos, p.page_no, p.attachment FROM sections s LEFT JOIN pages p ON p.scan = s.scan AND p.title = s.title
    """,
)
def section_pages(t: Tables) -> DataFrame:
    return G.section_pages(_scan_sections(t), _scan_pages(t)).select("scan", "title", "pos", "page_no", "attachment")


@query(
    "next_page",
    "WITH" + _SECTIONS + """
    SELECT s.scan, 'Assistant' AS section, coalesce(max(p.page_no), 0) + 1 AS page_no
    FROM (SELECT DISTINCT scan FROM sections) s LEFT JOIN pages p ON p.scan = s.scan AND p.title = 'Assistant' GROUP BY s.scan
    """,
)
def next_page(t: Tables) -> DataFrame:
    return G.next_page(_scan_sections(t), _scan_pages(t))


@query(
    "dense_pages",
    """
    WITH p AS (SELECT l_orderkey AS scan, l_returnflag AS section, l_partkey % 4 + 3 AS page_no,
                      l_linenumber * 10000000 + l_suppkey * 10000 + l_partkey AS pos FROM lineitem),
    f AS (SELECT scan, section, page_no, min(pos) AS first FROM p GROUP BY 1, 2, 3)
    SELECT p.scan, p.section, p.page_no, p.pos, d.n AS new_page_no FROM p JOIN (
      SELECT scan, section, page_no, row_number() OVER (PARTITION BY scan, section ORDER BY first, page_no) AS n FROM f) d
    ON d.scan = p.scan AND d.section = p.section AND d.page_no = p.page_no
    """,
)
def dense_pages(t: Tables) -> DataFrame:
    pages = t.lineitem.select(
        F.col("l_orderkey").alias("scan"),
        F.col("l_returnflag").alias("section"),
        (F.col("l_partkey") % 4 + 3).alias("page_no"),
        (F.col("l_linenumber").cast("bigint") * 10000000 + F.col("l_suppkey") * 10000 + F.col("l_partkey")).alias("pos"),
    )
    return G.dense_page_numbers(pages, bucket=10000000)


@query(
    "align_pages",
    """
    WITH live AS (
      SELECT conv_id AS scan, turn AS page_no, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place
      FROM conversations WHERE role <> 'system')
    SELECT l.scan, l.page_no, CASE WHEN c.turn IS NULL THEN 'unknown' ELSE c.role END AS section
    FROM live l LEFT JOIN conversations c ON c.conv_id = l.scan AND c.turn = l.place
    """,
)
def align_pages(t: Tables) -> DataFrame:
    details = t.conversations.select(
        F.col("conv_id").alias("scan"),
        F.concat_ws("-", "conv_id", "turn").alias("name"),
        F.col("turn").alias("page_no"),
        (F.col("role") == "system").cast("int").alias("is_deleted"),
    )
    results = t.conversations.select(
        F.col("conv_id").alias("scan"), F.col("turn").alias("page"), F.col("role").alias("section"),
        F.lit("Front").alias("page_type"), F.lit(0.5).alias("confidence"),
    )
    return G.align_pages(details, results).select("scan", "page_no", "section")


def _details(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("name"),
        F.col("l_orderkey").alias("scanner_document"),
        F.when(F.col("l_linestatus") == "F", 1).when(F.col("l_returnflag") != "N", 0).alias("is_deleted"),
    )


@query(
    "scan_replace",
    """
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS name,
           CASE WHEN listed THEN l_suppkey ELSE l_orderkey END AS scanner_document,
           CASE WHEN listed THEN 0 WHEN o_orderkey IS NOT NULL THEN 1 WHEN l_linestatus = 'F' THEN 1 WHEN l_returnflag <> 'N' THEN 0 END AS is_deleted
    FROM (SELECT *, l_linenumber = 2 AS listed FROM lineitem) l LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'O'
    """,
)
def scan_replace(t: Tables) -> DataFrame:
    """Open orders are saved again; all second pages move to their supplier's scan."""
    saved = t.orders.where(F.col("o_orderstatus") == "O").select(F.col("o_orderkey").alias("scan"))
    listed = t.lineitem.where(F.col("l_linenumber") == 2).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("name"), F.col("l_suppkey").alias("scan")
    )
    return G.replace_scan(_details(t), saved, listed)


@query(
    "purge_deleted",
    "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS name FROM lineitem WHERE l_linestatus <> 'F'",
)
def purge_deleted(t: Tables) -> DataFrame:
    return G.without_deleted(_details(t)).select("name")


@query(
    "purge_previews",
    """
    SELECT event_id FROM events WHERE NOT (event_type IN ('click', 'view') AND event_id % 2 = 1
      AND ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 15 MINUTE)
    """,
)
def purge_previews(t: Tables) -> DataFrame:
    """The pattern's underscores match any character: 'DataXBuilder...' goes too."""
    name = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("Data_Builder_Preview_"), "event_id"))
        .when(F.col("event_type") == "view", F.lit("DataXBuilderYPreviewZ.pdf"))
        .otherwise(F.lit("Other_Preview_1"))
    )
    files = t.events.select("event_id", name.alias("file_name"), (F.col("event_id") % 2).alias("is_private"), F.col("ts").alias("creation"))
    now = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return G.without_expired_previews(files, now).select("event_id")
