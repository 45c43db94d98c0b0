"""Text functions, mail merge, locating values, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertally.catalog.registry import Tables, query
from papertally.config import let
from papertally.functions import numbers as N
from papertally.functions import text as T
from papertally.functions.boxes import box
from papertally.operators import locate as LO
from papertally.operators import merge as MG
from papertally.operators import reports as R
from papertally.sources.logs import log_inventory


@query(
    "text_keys",
    r"""
    SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')) AS text_key,
           regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS match_key
    FROM documents
    """,
)
def text_keys(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.text_key(F.col("text")).alias("text_key"), T.match_key(F.col("text")).alias("match_key"))


@query(
    "slugs",
    "SELECT page_id, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 140) AS slug FROM pages",
)
def slugs(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.slug(F.col("url")).alias("slug"))


@query(
    "user_lists",
    """
    SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN 1 ELSE CASE WHEN p_name = p_type THEN 1 ELSE 2 END END AS n,
           CASE p_partkey % 3 WHEN 1 THEN p_name ELSE p_name || '|' || p_type END AS users
    FROM part
    """,
)
def user_lists(t: Tables) -> DataFrame:
    """As JSON, as comma text with doubles, as lines."""
    text = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('["'), "p_name", F.lit('", " '), "p_type", F.lit('", "", "'), "p_name", F.lit('"]')))
        .when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(", ,"), "p_name"))
        .otherwise(F.concat(F.lit(" "), "p_name", F.lit("\n"), "p_type", F.lit(",")))
    )
    users = t.part.select("p_partkey", T.user_list(text).alias("u"))
    return users.select("p_partkey", F.size("u").alias("n"), F.array_join("u", "|").alias("users"))


@query(
    "field_labels",
    """
    SELECT l_orderkey, l_partkey, l_suppkey,
           CASE WHEN l_returnflag = 'A' THEN 'Own' WHEN l_linestatus = 'O' THEN 'Meta'
                ELSE CASE l_linenumber WHEN 1 THEN 'Created On' WHEN 2 THEN 'ID' ELSE 'Posting Date' END END AS label
    FROM lineitem
    """,
)
def field_labels(t: Tables) -> DataFrame:
    name = F.when(F.col("l_linenumber") == 1, "creation").when(F.col("l_linenumber") == 2, "name").otherwise("posting_date")
    own = F.when(F.col("l_returnflag") == "A", " Own ").otherwise(" ")
    meta = F.when(F.col("l_linestatus") == "O", "Meta")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", T.field_label(name, own, meta).alias("label"))


@query(
    "truncated_replies",
    """
    SELECT page_id, length(html) - length(replace(html, '{', '')) > length(html) - length(replace(html, '}', '')) AS truncated FROM pages
    """,
)
def truncated_replies(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.looks_truncated(F.col("html")).alias("truncated"))


@query(
    "value_variants",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN v || '|' || replace(v, '.0', '')
                            ELSE o_orderpriority || '|' || v || '|' || replace(v, '.0', '') END AS forms
    FROM (SELECT *, o_custkey || '.0' AS v FROM orders) q
    """,
)
def value_variants(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderpriority")).otherwise("")
    forms = T.value_variants(raw, F.concat(F.col("o_custkey"), F.lit(".0")))
    return t.orders.select("o_orderkey", F.array_join(forms, "|").alias("forms"))


@query(
    "coerced_values",
    """
    SELECT o_orderkey, 'Check' AS fieldtype, CASE o_orderstatus WHEN 'O' THEN '1' ELSE '0' END AS value FROM orders
    UNION ALL SELECT o_orderkey, 'Int', CASE o_orderstatus WHEN 'P' THEN 'x' || o_custkey ELSE '-' || (1000 + o_custkey) END FROM orders
    UNION ALL SELECT o_orderkey, 'Float', CASE o_orderstatus WHEN 'P' THEN '0.0' ELSE CAST((-1000.75 - o_custkey)::DOUBLE AS VARCHAR) END FROM orders
    UNION ALL SELECT o_orderkey, 'Date', CASE o_orderstatus WHEN 'P' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END FROM orders
    UNION ALL SELECT o_orderkey, 'Data', o_orderpriority FROM orders
    """,
)
def coerced_values(t: Tables) -> DataFrame:
    progress = F.col("o_orderstatus") == "P"
    plain = F.col("o_custkey").cast("string")
    thousand = F.concat(F.lit("-"), F.format_number(F.col("o_custkey") + 1000, 0))
    entries = {
        "Check": F.when(F.col("o_orderstatus") == "O", " Yes ").otherwise("nope"),
        "Int": F.when(progress, F.concat(F.lit("x"), plain)).otherwise(F.concat(thousand, F.lit(".75"))),
        "Float": F.when(progress, "junk").otherwise(F.concat(thousand, F.lit(".75"))),
        "Date": F.when(progress, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        "Data": F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")),
    }
    rows = t.orders.select(
        "o_orderkey", F.inline(F.array(*[F.struct(F.lit(k).alias("fieldtype"), v.alias("raw")) for k, v in entries.items()]))
    )
    return rows.select("o_orderkey", "fieldtype", N.coerce_value(F.col("fieldtype"), F.col("raw")).alias("value"))


@query(
    "lenient_numbers",
    """
    SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 0 ELSE CAST(trunc(value) AS BIGINT) END AS as_int,
           CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 0 ELSE value END AS as_float
    FROM events
    """,
)
def lenient_numbers(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "12abc").when(F.col("event_type") == "click", F.lit("")).otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", N.cint(text).alias("as_int"), N.flt(text).alias("as_float"))


@query(
    "redacted_calls",
    """
    SELECT page_id, '{"messages": [{"content": [{"type": "text", "text": "read"}, {"type": "image_url", "image_url": {"url": "<image redacted: '
           || length(url) || ' chars>"}}]}]}' AS request_payload, html AS response_payload, url AS error_message,
           0.0::DOUBLE AS cost_usd, page_id % 7 AS prompt_tokens
    FROM pages
    """,
)
def redacted_calls(t: Tables) -> DataFrame:
    body = F.concat(
        F.lit('{"messages": [{"content": [{"type": "text", "text": "read"}, {"type": "image_url", "image_url": {"url": "'),
        F.col("url"), F.lit('"}}]}]}'),
    )
    calls = t.pages.select(
        "page_id",
        body.alias("request_payload"),
        F.col("html").alias("response_payload"),
        F.col("url").alias("error_message"),
        F.lit(None).cast("string").alias("cost_usd"),
        F.when(F.col("page_id") % 7 != 0, (F.col("page_id") % 7).cast("string")).alias("prompt_tokens"),
        F.lit("1").alias("completion_tokens"),
        F.lit("1").alias("total_tokens"),
        F.lit("0").alias("cost_estimated"),
    )
    return R.call_log_rows(calls).drop("completion_tokens", "total_tokens", "cost_estimated")


@query(
    "log_inventory",
    """
    SELECT split_part(split_part(url, '/', 3), '.', 1) || '.error' AS namespace, count(*) AS files FROM pages
    WHERE page_id % 4 <> 0 GROUP BY 1
    """,
)
def log_files(t: Tables) -> DataFrame:
    """Page hosts as log names: 'host.error.log.2' counts for 'host.error'."""
    host = F.split_part(F.split_part(F.col("url"), F.lit("/"), F.lit(3)), F.lit("."), F.lit(1))
    name = F.when(F.col("page_id") % 4 == 0, F.concat(host, F.lit(".txt"))).otherwise(F.concat(host, F.lit(".error.log."), F.col("page_id")))
    return log_inventory(t.pages.select(name.alias("name")))


CONSTANTS = {"company": "ACME & Co", "c_mktsegment": "ALL", "": "never"}
JOB = MG.MergeJob(
    name="Statement",
    target_field="c_name",
    subject="Balance of {{ c_name }}",
    body="Dear {{c_name}} ({{ c_mktsegment }}), {{ missing }}you owe {{ c_nationkey }} to {{ company }}.",
    sender="bills@example.com",
    attachment_naming_field="c_custkey",
)


@query("merge_rows", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'ALL' AS c_mktsegment, 'ACME & Co' AS company FROM customer")
def merge_rows(t: Tables) -> DataFrame:
    return MG.merge_rows(t.customer, CONSTANTS)


@query(
    "share_log",
    """
    SELECT c_custkey, 'Pending' AS log_status, 'Balance of ' || c_name AS email_subject,
           'Dear ' || c_name || ' (ALL), you owe ' || c_nationkey || ' to ACME & Co.' AS email_body, c_custkey || '.pdf' AS attachment_name,
           '{"from_email":"bills@example.com","to":"' || c_name || '","subject":"Balance of {{ c_name }}"}' AS args
    FROM customer
    """,
)
def share_log(t: Tables) -> DataFrame:
    log = MG.share_log(MG.merge_rows(t.customer, CONSTANTS), JOB, "clerk")
    return log.select("c_custkey", "log_status", "email_subject", "email_body", "attachment_name", "args")


@query(
    "share_outcome",
    """
    SELECT o_orderkey AS name, CASE WHEN o_orderstatus <> 'P' OR e.user_id IS NULL THEN CASE o_orderstatus WHEN 'P' THEN 'Pending' ELSE 'Success' END
                                    WHEN e.bad THEN 'Failed' ELSE 'Processing' END AS log_status,
           CASE WHEN o_orderstatus = 'P' AND NOT e.bad THEN 'q' || o_orderkey END AS email_queue,
           CASE WHEN o_orderstatus = 'P' AND e.bad THEN 'broken' END AS error_log
    FROM orders LEFT JOIN (SELECT user_id, bool_or(event_type = 'error' AND value > 150) AS bad FROM events GROUP BY 1) e ON e.user_id = o_orderkey
    """,
)
def share_outcome(t: Tables) -> DataFrame:
    log = t.orders.select(
        F.col("o_orderkey").alias("name"),
        F.when(F.col("o_orderstatus") == "P", "Pending").otherwise("Success").alias("log_status"),
        F.lit(None).cast("string").alias("email_queue"),
        F.lit(None).cast("string").alias("error_log"),
    )
    bad = F.bool_or((F.col("event_type") == "error") & (F.col("value") > 150))
    outcomes = t.events.groupBy(F.col("user_id").alias("name")).agg(F.when(bad, "broken").alias("error"))
    return MG.share_outcome(log, outcomes.withColumn("email_queue", F.concat(F.lit("q"), "name")))


@query(
    "status_sync",
    """
    SELECT o_orderkey AS name, CASE WHEN o_orderstatus = 'O' AND event_id IS NOT NULL THEN
             CASE event_type WHEN 'click' THEN 'Processing' WHEN 'view' THEN 'Processing' WHEN 'purchase' THEN 'Success' ELSE 'Failed' END
           WHEN o_orderstatus = 'O' THEN 'Processing' ELSE 'Pending' END AS log_status
    FROM orders LEFT JOIN events ON event_id = o_orderkey
    """,
)
def status_sync(t: Tables) -> DataFrame:
    log = t.orders.select(
        F.col("o_orderkey").alias("name"),
        F.when(F.col("o_orderstatus") == "O", "Processing").otherwise("Pending").alias("log_status"),
        F.lit("Email").alias("share_type"),
        F.col("o_orderkey").alias("email_queue"),
    )
    state = F.when(F.col("event_type") == "click", "Not Sent").when(F.col("event_type") == "view", "Sending").when(
        F.col("event_type") == "purchase", "Sent"
    ).when(F.col("event_type") == "error", "Error")
    queue = t.events.select(F.col("event_id").alias("name"), state.alias("status"))
    return MG.sync_delivery(log, queue).select("name", "log_status")


def document_words(t: Tables) -> DataFrame:
    """Words of whole documents: a text line is a line of the page, the place of
    a word among those of its line its x. Boxes take nine tenths of their place,
    so that no two words of a page overlap."""

    # pieces carry how many there are, so that no text is split again for each of its pieces
    def pieces(text: Column, sep: str, size: str, place: str, piece: str) -> Column:
        numbered = lambda all_: F.transform(all_, lambda p, i: F.struct(F.size(all_).alias(size), i.alias(place), p.alias(piece)))
        return F.inline(let(F.split(text, sep), numbered))

    lines = t.documents.select("doc_id", pieces(F.col("text"), "\n", "n_lines", "line", "body"))
    words = lines.select("doc_id", "line", "n_lines", pieces(F.col("body"), "[ \t]+", "n_words", "n", "text")).where(F.col("text") != "")
    place = box(F.col("n") / F.col("n_words"), F.col("line") / F.col("n_lines"), 0.9 / F.col("n_words"), 0.9 / F.col("n_lines"))
    return words.select(F.col("doc_id").alias("page"), "line", "text", place.alias("bbox"))


def document_targets(t: Tables) -> DataFrame:
    """Of every document its longest word, and the same misread in one letter."""
    words = F.split("text", "[ \t\n]+")
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    found = t.documents.select("doc_id", longest.alias("w")).where(F.length(T.match_key(F.col("w"))) >= 4)
    misread = F.concat(F.substring("w", 1, 2), F.lit("q"), F.expr("substring(w, 4)"))
    both = F.array(F.struct(F.lit("read").alias("target"), F.col("w").alias("form")), F.struct(F.lit("misread").alias("target"), misread.alias("form")))
    return found.select(F.col("doc_id").alias("page"), F.inline(both)).select("page", "target", F.array("form").alias("forms"))


@query("locate_value")
def locate_value(t: Tables) -> DataFrame:
    clusters = LO.top_clusters(LO.scored_windows(document_words(t), document_targets(t)))
    return clusters.select("page", "target", "rank", "score", "text", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"))


@query("certain_location")
def certain_location(t: Tables) -> DataFrame:
    clusters = LO.top_clusters(LO.scored_windows(document_words(t), document_targets(t)))
    sure = LO.certain_location(clusters)
    return sure.select("page", "target", "score", "text", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"))


@query("tightened_boxes")
def tightened_boxes(t: Tables) -> DataFrame:
    """Claimed boxes on the upper part of the page, a line too low."""
    targets = document_targets(t)
    clusters = LO.top_clusters(LO.scored_windows(document_words(t), targets))
    claimed = targets.select("page", "target", box(F.lit(0.0), F.lit(0.05), F.lit(1.0), F.lit(0.05)).alias("bbox"))
    snapped = LO.tighten_boxes(claimed, clusters)
    return snapped.select("page", "target", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"), "snapped")


# Pages whose words have 32 letters drawn by a digest: different words are far
# from alike, and one replaced letter makes a ratio of 31/32.
_PRINTED = """
    WITH words AS (
      SELECT l_orderkey AS page, l_linestatus AS line, l_partkey AS p, l_linenumber AS n, md5('' || l_partkey) AS text,
             CAST((l_linenumber - 1) / 8 AS DOUBLE) AS x, CASE l_linestatus WHEN 'F' THEN 0.04::DOUBLE ELSE 0.5::DOUBLE END AS y FROM lineitem),
    boxed AS (
      SELECT page, line, text, x, y, row_number() OVER (PARTITION BY page, line ORDER BY x, text) AS start FROM words),
    wanted AS (SELECT l_orderkey AS page, md5('' || min(l_partkey)) AS word FROM lineitem GROUP BY 1),
    targets AS (SELECT page, 'read' AS target, word, 1.0::DOUBLE AS score FROM wanted
                UNION ALL SELECT page, 'misread', word, 0.9688::DOUBLE FROM wanted),
    spots AS (SELECT t.page, t.target, t.score, b.text, b.x, b.y, min(b.line) AS line, min(b.start) AS start
              FROM targets t JOIN boxed b ON b.page = t.page AND b.text = t.word GROUP BY ALL),
    clusters AS (SELECT page, target, row_number() OVER (PARTITION BY page, target ORDER BY line, start) AS rank, score, text, x, y FROM spots),
    sure AS (SELECT page, target, score, text, x, y FROM clusters QUALIFY count(*) OVER (PARTITION BY page, target) = 1)
    """


def printed_words(t: Tables) -> DataFrame:
    """A word for each line of an order, in two text lines of its page."""
    place = box(
        (F.col("l_linenumber") - 1) / 8, F.when(F.col("l_linestatus") == "F", 0.04).otherwise(0.5), F.lit(0.1), F.lit(0.05)
    )
    return t.lineitem.select(
        F.col("l_orderkey").alias("page"), F.col("l_linestatus").alias("line"), F.md5(F.col("l_partkey").cast("string")).alias("text"), place.alias("bbox")
    )


def printed_targets(t: Tables) -> DataFrame:
    """A word of each page, the same misread in a letter, and one that is not there."""
    word = F.md5(F.min("l_partkey").cast("string"))
    found = t.lineitem.groupBy(F.col("l_orderkey").alias("page")).agg(word.alias("w"))
    misread = F.concat(F.substring("w", 1, 11), F.lit("g"), F.expr("substring(w, 13)"))
    named = [("read", F.col("w")), ("misread", misread), ("absent", F.reverse(F.md5("w")))]
    each = F.array(*[F.struct(F.lit(n).alias("target"), form.alias("form")) for n, form in named])
    return found.select("page", F.inline(each)).select("page", "target", F.array("form").alias("forms"))


def _printed(t: Tables) -> DataFrame:
    return LO.top_clusters(LO.scored_windows(printed_words(t), printed_targets(t)))


@query("locate_printed", _PRINTED + "SELECT page, target, rank, score, text, x, y FROM clusters WHERE rank <= 8")
def locate_printed(t: Tables) -> DataFrame:
    return _printed(t).select("page", "target", "rank", "score", "text", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"))


@query("certain_printed", _PRINTED + "SELECT page, target, score, text, x, y FROM sure")
def certain_printed(t: Tables) -> DataFrame:
    sure = LO.certain_location(_printed(t))
    return sure.select("page", "target", "score", "text", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"))


@query(
    "tightened_printed",
    _PRINTED + """
    , kept AS (SELECT page, target, x, y FROM (SELECT c.* FROM clusters c LEFT JOIN orders ON o_orderkey = page
                      WHERE NOT (o_orderpriority IS NOT DISTINCT FROM '5-LOW' AND y < 0.4))
               QUALIFY count(*) OVER (PARTITION BY page, target) = 1),
    claims AS (SELECT page, unnest(['read', 'misread', 'absent']) AS target FROM wanted)
    SELECT page, target, CASE WHEN k.y < 0.4 THEN k.x ELSE 0::DOUBLE END AS x, CASE WHEN k.y < 0.4 THEN k.y ELSE 0.08::DOUBLE END AS y,
           coalesce(k.y < 0.4, false) AS snapped
    FROM claims LEFT JOIN kept k USING (page, target)
    """,
)
def tightened_printed(t: Tables) -> DataFrame:
    """Claims across the page, a little below its first text line. In orders of
    low priority places of that line were rejected before."""
    words = printed_words(t)
    clusters = _printed(t)
    low = t.orders.where(F.col("o_orderpriority") == "5-LOW").select(F.col("o_orderkey").alias("page"))
    first = words.where(F.col("line") == "F").select("page", "bbox").join(low, "page")
    rejected = first.select("page", F.explode(F.array(F.lit("read"), F.lit("misread"))).alias("target"), "bbox")
    claimed = printed_targets(t).select("page", "target", box(F.lit(0.0), F.lit(0.08), F.lit(1.0), F.lit(0.05)).alias("bbox"))
    snapped = LO.tighten_boxes(claimed, clusters, rejected)
    return snapped.select("page", "target", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"), "snapped")
