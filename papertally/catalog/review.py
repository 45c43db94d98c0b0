"""The review screen. Events are runs and feedback: the user is the document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertally.catalog import matching as MC
from papertally.catalog.registry import Tables, query
from papertally.operators import review as V
from papertally.operators.quality import FieldSpec
from papertally.plans import reconcile as P
from papertally.plans.settings import match_settings


def runs(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "Needs Review").when(F.col("event_type") == "purchase", "Completed").otherwise("Failed")
    return t.events.select(
        F.col("event_id").alias("name"),
        F.concat(F.lit("A"), F.col("event_id") % 3).alias("action"),
        status.alias("status"),
        F.lit("Order").alias("reference_doctype"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).otherwise("").alias("reference_name"),
        F.when(F.col("event_id") % 2 == 0, F.lit("d")).alias("reference_detail"),
        F.col("ts").alias("creation"),
    )


def _queue(cap: str) -> str:
    return f"""
    WITH runs AS (
      SELECT event_id AS name, event_type, CASE WHEN user_id % 10 <> 0 THEN '' || user_id ELSE '' END AS ref,
             CASE WHEN event_id % 2 = 0 THEN 'd' END AS detail, ts FROM events),
    waiting AS (SELECT * FROM runs WHERE event_type = 'error' AND ref <> '' {cap}),
    latest AS (SELECT ref, detail, max(ts) AS ts, arg_max(name, ts) AS name FROM waiting GROUP BY 1, 2)
    SELECT name, ref AS reference_name, ts AS creation, coalesce(detail, ref) AS title FROM latest l
    WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.event_type = 'purchase' AND r.ref = l.ref
                      AND coalesce(r.detail, '') = coalesce(l.detail, '') AND r.ts > l.ts)
    """


@query("review_queue", _queue("ORDER BY ts DESC, name DESC LIMIT 100"))
def review_queue(t: Tables) -> DataFrame:
    """As the screen shows it: the scan is cut to the newest hundred."""
    return V.review_queue(runs(t), scan_limit=V.QUEUE_LIMIT).select("name", "reference_name", "creation", "title")


@query("review_queue_whole", _queue(""))
def review_queue_whole(t: Tables) -> DataFrame:
    return V.review_queue(runs(t)).select("name", "reference_name", "creation", "title")


@query(
    "latest_per_reference",
    """
    SELECT user_id, detail, max(ts) AS creation FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'd' END AS detail FROM events) q
    WHERE user_id % 10 <> 0 GROUP BY 1, 2
    """,
)
def latest_per_reference(t: Tables) -> DataFrame:
    latest = V.latest_per_reference(runs(t).where(F.col("reference_name") != ""))
    return latest.select(F.col("reference_name").cast("bigint").alias("user_id"), F.col("reference_detail").alias("detail"), "creation")


def feedback_events(t: Tables) -> DataFrame:
    verdict = (
        F.when(F.col("event_type") == "click", "correct")
        .when(F.col("event_type") == "view", "wrong")
        .when(F.col("event_type") == "purchase", "corrected")
        .when(F.col("event_type") == "error", "clear")
        .otherwise("added")
    )
    k = F.get_json_object("props", "$.k").cast("int")
    field = F.when(k % 4 == 0, "status").when(k % 4 == 1, "priority").otherwise("bills")
    index = F.when(field == "bills", k % 5)
    return t.events.select(
        F.col("user_id").alias("doc"),
        field.alias("field"),
        index.alias("idx"),
        verdict.alias("verdict"),
        F.concat(F.lit("v"), "event_id").alias("value"),
        F.col("event_type").alias("by"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
    )


_FEEDBACK = """
    fe AS (
      SELECT user_id AS doc, k, CASE k % 4 WHEN 0 THEN 'status' WHEN 1 THEN 'priority' ELSE 'bills' END AS field,
             CASE WHEN k % 4 > 1 THEN k % 5 END AS idx,
             CASE event_type WHEN 'click' THEN 'correct' WHEN 'view' THEN 'wrong' WHEN 'purchase' THEN 'corrected' WHEN 'error' THEN 'clear' ELSE 'added' END AS verdict,
             'v' || event_id AS value, ts, event_id
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) q),
    folded AS (
      SELECT doc, field, idx, r.v AS verdict, r.x AS value, ts FROM (
        SELECT doc, field, idx, arg_max({'v': verdict, 'x': CASE WHEN verdict = 'corrected' THEN value END}, ts) AS r, max(ts) AS ts
        FROM fe WHERE verdict <> 'added' GROUP BY 1, 2, 3) g WHERE r.v <> 'clear'),
    added AS (
      SELECT doc, field, value, ts, CAST(row_number() OVER (PARTITION BY doc ORDER BY ts) AS INTEGER) AS pos
      FROM fe WHERE verdict = 'added'),
    items AS (
      SELECT o_orderkey AS doc, 'status' AS key, NULL AS idx, o_orderstatus AS value FROM orders WHERE o_orderstatus <> 'P'
      UNION ALL SELECT o_orderkey, 'priority', NULL, o_orderpriority FROM orders
      UNION ALL SELECT doc, 'bills', CAST(row_number() OVER (PARTITION BY doc ORDER BY n) AS INTEGER) - 1, '' || p
      FROM (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) b)
    """


@query("feedback_fold", "WITH" + _FEEDBACK + 'SELECT doc, field, idx, verdict, value, ts AS "at" FROM folded')
def feedback_fold(t: Tables) -> DataFrame:
    return V.feedback_fold(feedback_events(t)).select("doc", "field", "idx", "verdict", "value", "at")


@query("added_values", "WITH" + _FEEDBACK + "SELECT doc, field, value, pos FROM added")
def added_values(t: Tables) -> DataFrame:
    return V.added_values(feedback_events(t)).select("doc", "field", "value", "pos")


@query(
    "rejected_feedback",
    "WITH" + _FEEDBACK + """
    , long AS (SELECT doc, field, event_id AS seq, verdict, repeat('x', CAST(event_id % 700 AS INTEGER)) AS value FROM fe)
    SELECT doc, field, seq, 'value' AS refused FROM long
    WHERE (verdict IN ('corrected', 'added') AND length(value) > 500) OR (verdict = 'added' AND value = '')
    """,
)
def rejected_feedback(t: Tables) -> DataFrame:
    """Values of up to 699 characters: those over 500 are refused, and empty additions."""
    events = feedback_events(t).withColumn("value", F.expr("repeat('x', CAST(seq % 700 AS INT))"))
    return V.rejected_feedback(events).select("doc", "field", "seq", "refused")


SCHEMA = [FieldSpec("status", is_title=True), FieldSpec("priority"), FieldSpec("bills", kind="array")]


def run_items(t: Tables) -> DataFrame:
    """What the model read: status (not for orders in progress), priority, bills."""
    one = t.orders.select(
        F.col("o_orderkey").alias("doc"),
        F.lit(None).cast("int").alias("idx"),
        F.inline(
            F.array(
                F.struct(F.lit("status").alias("key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("value")),
                F.struct(F.lit("priority").alias("key"), F.col("o_orderpriority").alias("value")),
            )
        ),
    ).where(F.col("value").isNotNull())
    # line numbers 1..7: at most seven bills per order
    bills = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    listed = bills.groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p"))).alias("ps"))
    many = listed.select("doc", F.posexplode("ps").alias("idx", "_p")).select(
        "doc", "idx", F.lit("bills").alias("key"), F.col("_p.p").cast("string").alias("value")
    )
    return one.unionByName(many).withColumn("raw_text", F.col("value"))


@query(
    "overlay",
    "WITH" + _FEEDBACK + """
    , fixes AS (SELECT doc, field AS key, idx, value FROM folded WHERE verdict = 'corrected'),
    sizes AS (SELECT doc, count(*) AS n FROM items WHERE key = 'bills' GROUP BY 1)
    SELECT i.doc, i.key, i.idx, coalesce(f.value, i.value) AS value, CASE WHEN f.value IS NULL THEN 'model' ELSE 'corrected' END AS origin
    FROM items i LEFT JOIN fixes f ON f.doc = i.doc AND f.key = i.key AND f.idx IS NOT DISTINCT FROM i.idx
    UNION ALL
    SELECT f.doc, f.key, NULL, f.value, 'corrected' FROM fixes f
    WHERE f.key <> 'bills' AND NOT EXISTS (SELECT 1 FROM items i WHERE i.doc = f.doc AND i.key = f.key)
    UNION ALL
    SELECT a.doc, 'bills', CAST(coalesce(s.n, 0) + row_number() OVER (PARTITION BY a.doc ORDER BY a.pos) - 1 AS INTEGER), a.value, 'added'
    FROM added a LEFT JOIN sizes s ON s.doc = a.doc WHERE a.field = 'bills'
    """,
)
def overlay(t: Tables) -> DataFrame:
    events = feedback_events(t)
    fixed = V.overlay_corrections(run_items(t), V.feedback_fold(events), V.added_values(events), SCHEMA)
    return fixed.select("doc", "key", "idx", "value", "origin")


@query(
    "model_values",
    "WITH" + _FEEDBACK + """
    SELECT f.doc, f.field, f.idx, f.verdict, i.value AS model_value FROM folded f
    LEFT JOIN items i ON i.doc = f.doc AND i.key = f.field AND i.idx IS NOT DISTINCT FROM f.idx
    """,
)
def model_values(t: Tables) -> DataFrame:
    given = V.model_values(V.feedback_fold(feedback_events(t)), run_items(t))
    return given.select("doc", "field", "idx", "verdict", "model_value")


@query("document_titles", "SELECT o_orderkey AS doc, CASE o_orderstatus WHEN 'P' THEN o_orderpriority ELSE o_orderstatus END AS title FROM orders WHERE o_orderkey IS NOT NULL UNION ALL SELECT doc, '' || arg_min(p, n) FROM (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_partkey) AS p FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2) q GROUP BY 1")
def document_titles(t: Tables) -> DataFrame:
    return V.document_titles(run_items(t), SCHEMA)


@query(
    "resolution_trail",
    """
    WITH ev AS (SELECT user_id, count(*) AS n,
                  bool_or(event_type = 'view' OR (event_type = 'click' AND value >= 5 AND event_id % 2 = 0)) AS closed
                FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1)
    SELECT o_orderkey AS name, CASE WHEN o_orderstatus = 'P' AND coalesce(closed, false) THEN 'Completed'
                                    WHEN o_orderstatus = 'P' THEN 'Needs Review' ELSE 'Failed' END AS status, coalesce(n, 0) AS n_resolutions
    FROM orders LEFT JOIN ev ON user_id = o_orderkey
    """,
)
def resolution_trail(t: Tables) -> DataFrame:
    waiting = t.orders.select(
        F.col("o_orderkey").alias("name"), F.when(F.col("o_orderstatus") == "P", "Needs Review").otherwise("Failed").alias("status")
    )
    kind = F.when(F.col("event_type") == "click", "finalize").when(F.col("event_type") == "view", "close").otherwise("escalate")
    events = t.events.where(F.col("event_type").isin("click", "view", "error")).select(
        F.col("user_id").alias("run"),
        kind.alias("kind"),
        (F.col("value") >= 5).alias("ok"),
        F.when(F.col("event_id") % 2 == 1, F.lit(False)).alias("complete"),
        F.col("ts").alias("at"),
    )
    return V.resolution_trail(waiting, events)


@query(
    "review_context",
    """
    SELECT o_orderkey AS doc,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'saved' ELSE CAST(CAST(o_orderdate AS DATE) - 60 AS VARCHAR) END AS date_from,
           CASE o_orderpriority WHEN '1-URGENT' THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + 3 AS VARCHAR) END AS date_to,
           CASE o_orderpriority WHEN '1-URGENT' THEN NULL ELSE 'always' END AS mode
    FROM orders
    """,
)
def review_context(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("creation"))
    saved = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("doc"), F.lit("saved").alias("date_from"), F.lit(None).cast("string").alias("date_to"), F.lit(None).cast("string").alias("mode")
    )
    return V.review_context(rows, {"date_from": "-60d", "date_to": "+3d", "mode": "always"}, saved)


@query(
    "review_fill_in",
    "WITH" + MC.PARTIES + "," + MC.RESOLVED + MC._SCORED + """
    SELECT s.doc, s.name, s.confidence, s.matched_value FROM scored s JOIN orders o ON o.o_orderkey = s.doc
    WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH')
      AND s.doc NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')
    """,
)
def review_fill_in(t: Tables) -> DataFrame:
    """Urgent runs wait; those of buyers have stored matches."""
    waiting = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        F.col("o_orderkey").alias("name"), F.lit("Needs Review").alias("status"), F.col("o_orderdate").alias("creation")
    )
    stored = t.events.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("doc"))
    windows = V.review_context(V.runs_to_fill(waiting, stored), {"context_from": "-60d", "context_to": "+3d"})
    filled = P.fill_in_candidates(windows, MC.references(t), MC.parties(t), match_settings(MC.SETTINGS))
    return filled.select("doc", "name", "confidence", "matched_value")
