"""Formats, boxes, checks, the gate, repairs.

Documents are orders; each is given the fields of a freight receipt, printed in
several ways.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertally.catalog.registry import Tables, query
from papertally.functions import boxes as B
from papertally.operators import quality as Q
from papertally.plans import reconcile as P
from papertally.session import spread, written

SCHEMA = [
    Q.FieldSpec("lr_number", required=True, format="strip-spaces", bbox_required=True),
    Q.FieldSpec("lr_date", required=True, format="date:indian-ddmmyyyy", bbox_required=True),
    Q.FieldSpec("freight_amount", required=True, format="amount"),
    Q.FieldSpec("eway_bill", format="digits:12"),
    Q.FieldSpec("series", format=r"regex:[A-Z]{2}[0-9]{2}"),
    Q.FieldSpec("bill_numbers", kind="array", required=True, bbox_required=True),
]


def receipt_items(t: Tables) -> DataFrame:
    """Items of every order: one per field, and one bill number per line."""
    day = F.col("o_orderdate")
    status = F.col("o_orderstatus")
    key = F.col("o_orderkey")
    printed_date = (
        F.when(status == "F", F.date_format(day, "dd/MM/yyyy"))
        .when(status == "O", F.concat(F.dayofmonth(day), F.lit(" "), F.date_format(day, "MMM yyyy")))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit("32/13/2026"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit(""))
        .otherwise(F.date_format(day, "d.M.yy"))
    )
    whole = F.floor("o_totalprice").cast("bigint")
    amount = (
        F.when(status == "F", F.concat(F.lit("₹"), F.floor(whole / 1000).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(".50")))
        .when(status == "O", F.concat(F.lit("Rs "), whole.cast("string")))
        .otherwise(F.lit("n/a"))
    )
    number = F.lpad(F.col("o_custkey").cast("string"), F.when(status == "P", 11).otherwise(12), "0")
    eway = F.concat_ws(" ", F.substring(number, 1, 4), F.substring(number, 5, 4), F.substring(number, 9, 4))
    series = F.concat(F.when(F.col("o_custkey") % 3 == 0, F.lit("ab")).otherwise("AB"), F.lpad((key % 120).cast("string"), 2, "0"))
    left = (key % 8) / 10
    own = {
        "lr_number": (
            F.concat(F.lit(" TND"), key.cast("string"), F.lit(" ")),
            F.when(status == "O", F.concat(F.lit("TND - "), key.cast("string"))).otherwise(F.concat(F.lit("LR TND-"), key.cast("string"))),
            B.canonical_box(left, F.lit(0.1), F.lit(0.2), F.lit(0.04)),
        ),
        "lr_date": (printed_date, printed_date, F.when(status != "F", B.canonical_box(left, F.when(key % 5 == 0, 0.1).otherwise(0.3), F.lit(0.2), F.lit(0.04)))),
        "freight_amount": (amount, amount, F.when(key % 7 == 0, B.canonical_box(F.lit(0.1), F.lit(0.1), F.lit(0.7), F.lit(0.6)))),
        "eway_bill": (F.when(key % 4 != 0, eway), eway, F.lit(None)),
        "series": (series, series, F.lit(None)),
    }
    none = F.lit(None).cast("int").alias("idx")
    orders = spread(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
    # one pass per field: all in one make a method too long for the JVM to compile
    fields = functools.reduce(
        lambda a, b: a.unionByName(b),
        [
            orders.select(
                key.alias("doc"), none, F.lit(k).alias("key"), v.alias("value"), r.alias("raw_text"), b.cast(B.BOX_TYPE).alias("bbox")
            )
            for k, (v, r, b) in own.items()
        ],
    )
    bills = t.lineitem.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx")).agg(F.min("l_partkey").alias("p"))
    text = F.concat(F.lit("B-"), F.col("p").cast("string"))
    boxed = F.when(F.col("p") % 3 != 0, B.canonical_box(F.lit(0.1), F.col("idx") / 10, F.lit(0.2), F.lit(0.05)))
    lines = bills.select("doc", "idx", F.lit("bill_numbers").alias("key"), text.alias("value"), text.alias("raw_text"), boxed.alias("bbox"))
    return fields.unionByName(lines).withColumn("confidence", F.lit(0.9))


def _docs(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("doc"), "o_orderstatus")


_ITEMS = """
    items AS (
      SELECT o_orderkey AS doc, o_orderstatus AS st, o_orderpriority AS pr, o_custkey AS c, o_orderdate AS d,
             CAST(floor(o_totalprice) AS BIGINT) AS whole,
             lpad(CAST(o_custkey AS VARCHAR), CASE o_orderstatus WHEN 'P' THEN 11 ELSE 12 END, '0') AS number FROM orders),
    shaped AS (
      SELECT doc, 'lr_number' AS key, CASE WHEN st = 'O' THEN 'TND-' || doc ELSE 'TND' || doc END AS value, true AS ok FROM items
      UNION ALL
      SELECT doc, 'lr_date', CASE WHEN st = 'P' AND pr = '1-URGENT' THEN '32/13/2026' WHEN st = 'P' AND pr = '5-LOW' THEN ''
                                  WHEN st = 'P' THEN '20' || strftime(d, '%y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END, NOT (st = 'P' AND pr = '1-URGENT') FROM items
      UNION ALL
      SELECT doc, 'freight_amount', CASE st WHEN 'F' THEN whole || '.5' WHEN 'O' THEN whole || '.0' ELSE 'n/a' END, st <> 'P' FROM items
      UNION ALL
      SELECT doc, 'eway_bill', CASE WHEN doc % 4 <> 0 THEN number END, doc % 4 = 0 OR st <> 'P' FROM items
      UNION ALL
      SELECT doc, 'series', CASE WHEN c % 3 = 0 THEN 'ab' ELSE 'AB' END || CASE WHEN doc % 120 > 99 THEN left('' || doc % 120, 2) ELSE lpad('' || doc % 120, 2, '0') END,
             c % 3 <> 0 FROM items)
    """


@query(
    "formats_quality",
    "WITH" + _ITEMS + """
    SELECT doc, key, CAST(NULL AS INTEGER) AS idx, value, ok AS format_ok FROM shaped
    UNION ALL SELECT l_orderkey, 'bill_numbers', l_linenumber, 'B-' || min(l_partkey), true FROM lineitem GROUP BY 1, 2, 3
    """,
)
def formats_quality(t: Tables) -> DataFrame:
    return Q.apply_formats(receipt_items(t), SCHEMA).select("doc", "key", "idx", "value", "format_ok")


_DEFICIENCIES = _ITEMS + """
    , bills AS (SELECT l_orderkey AS doc, l_linenumber AS idx, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
    found AS (
      SELECT doc, key, CAST(NULL AS INTEGER) AS idx, 'format' AS kind FROM shaped WHERE NOT ok
      UNION ALL SELECT doc, 'lr_date', NULL, 'bbox_missing' FROM items WHERE st = 'F'
      UNION ALL SELECT doc, 'freight_amount', NULL, 'bbox_insane' FROM items WHERE doc % 7 = 0
      UNION ALL SELECT doc, 'bill_numbers', idx, 'bbox_missing' FROM bills WHERE p % 3 = 0
      UNION ALL SELECT doc, 'lr_date', NULL, 'missing_value' FROM items WHERE st = 'P' AND pr = '5-LOW'
      UNION ALL SELECT doc, 'bill_numbers', NULL, 'missing_value' FROM items WHERE doc NOT IN (SELECT doc FROM bills)
      UNION ALL SELECT doc, 'lr_number', NULL, 'bbox_collision' FROM items WHERE st <> 'F' AND doc % 5 = 0)
    """


def _deficiencies(t: Tables) -> tuple[DataFrame, DataFrame]:
    # four checks and the gate read the items: shape them once
    items = written(Q.apply_formats(receipt_items(t), SCHEMA))
    found = (
        Q.item_deficiencies(items, SCHEMA)
        .unionByName(Q.missing_required(items, _docs(t), SCHEMA))
        .unionByName(Q.box_collisions(items, SCHEMA))
    )
    return items, found


@query("deficiencies", "WITH" + _DEFICIENCIES + "SELECT doc, key, idx, kind FROM found")
def deficiencies(t: Tables) -> DataFrame:
    return _deficiencies(t)[1].select("doc", "key", "idx", "kind")


_GATED = _DEFICIENCIES + """
    , every AS (
      SELECT doc, key, CAST(NULL AS INTEGER) AS idx FROM shaped
      UNION ALL SELECT doc, 'bill_numbers', idx FROM bills),
    kinds AS (
      SELECT doc, key, idx, string_agg(kind, ',' ORDER BY list_position(
               ['format', 'missing_value', 'bbox_missing', 'bbox_insane', 'bbox_collision'], kind)) AS kinds
      FROM found GROUP BY 1, 2, 3),
    gated AS (
      SELECT e.doc, e.key, e.idx,
             CASE WHEN k.kinds IS NULL AND i.st <> 'O' THEN 'Approved' ELSE 'Pending' END AS status,
             CASE WHEN k.kinds IS NOT NULL THEN k.kinds WHEN i.st = 'O' OR i.st IS NULL THEN 'manual mode' ELSE 'all checks passed' END AS reason
      FROM every e LEFT JOIN items i ON i.doc = e.doc
      LEFT JOIN kinds k ON k.doc = e.doc AND k.key = e.key AND k.idx IS NOT DISTINCT FROM e.idx
      UNION ALL
      SELECT doc, key, NULL, 'Pending', kinds FROM kinds WHERE key = 'bill_numbers' AND idx IS NULL)
    """


def _gate(t: Tables) -> DataFrame:
    items, found = _deficiencies(t)
    return Q.gate(items, written(found), SCHEMA, _docs(t), F.col("o_orderstatus") != "O")


@query("gate_status", "WITH" + _GATED + "SELECT doc, key, idx, status, reason FROM gated")
def gate_status(t: Tables) -> DataFrame:
    return _gate(t)


@query(
    "verdict_summary",
    "WITH" + _GATED + """
    SELECT doc, key, count(*) FILTER (status = 'Approved') AS n_approved, count(*) FILTER (status = 'Pending') AS n_pending,
           string_agg(status, ',' ORDER BY coalesce(idx, -1)) AS statuses
    FROM gated GROUP BY 1, 2
    """,
)
def verdict_summary(t: Tables) -> DataFrame:
    return Q.verdict_summary(_gate(t)).withColumn("statuses", F.array_join("statuses", ","))


_CROSS_CHECKED = _DEFICIENCIES + """
    , checked AS (SELECT i.doc, i.doc % 4 <> 0 AND (i.c % 2 = 0 AND i.st <> 'P') AS hit, i.doc % 4 <> 0 AS asked, i.number FROM items i)
    """


@query(
    "gate_cross_checked",
    "WITH" + _CROSS_CHECKED + """
    , more AS (SELECT doc, key, idx, kind FROM found
               UNION ALL SELECT doc, 'eway_bill', NULL, 'cross_check_miss' FROM checked WHERE asked AND NOT hit),
    every AS (
      SELECT doc, key, CAST(NULL AS INTEGER) AS idx FROM shaped
      UNION ALL SELECT doc, 'bill_numbers', idx FROM bills),
    kinds AS (
      SELECT doc, key, idx, string_agg(kind, ',' ORDER BY list_position(
               ['format', 'missing_value', 'bbox_missing', 'bbox_insane', 'bbox_collision', 'cross_check_miss'], kind)) AS kinds
      FROM more GROUP BY 1, 2, 3)
    SELECT e.doc, e.key, e.idx,
           CASE WHEN k.kinds IS NULL AND i.st <> 'O' THEN 'Approved' ELSE 'Pending' END AS status,
           CASE WHEN k.kinds IS NOT NULL THEN k.kinds WHEN i.st = 'O' OR i.st IS NULL THEN 'manual mode'
                WHEN e.key = 'eway_bill' AND c.hit THEN 'ground-truth cross-check' ELSE 'all checks passed' END AS reason
    FROM every e LEFT JOIN items i ON i.doc = e.doc LEFT JOIN checked c ON c.doc = e.doc
    LEFT JOIN kinds k ON k.doc = e.doc AND k.key = e.key AND k.idx IS NOT DISTINCT FROM e.idx
    UNION ALL
    SELECT doc, key, NULL, 'Pending', kinds FROM kinds WHERE key = 'bill_numbers' AND idx IS NULL
    """,
)
def gate_cross_checked(t: Tables) -> DataFrame:
    """Bills are looked up among those of customers with an even number: what is
    found there is the strongest evidence, what is not is a deficiency."""
    items = Q.apply_formats(receipt_items(t), SCHEMA)
    checks = P.check_items(items, _docs(t), SCHEMA, F.col("o_orderstatus") != "O", {"eway_bill": (_known_bills(t), "number", "E-way Bill")})
    return checks.verdicts


def _known_bills(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_custkey") % 2 == 0).select(F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("number"))


@query(
    "cross_check_misses",
    "WITH" + _CROSS_CHECKED + """
    SELECT doc, 'eway_bill' AS key, concat('no E-way Bill found with number = ', chr(39), number, chr(39),
                                           ' — re-read the value from the image') AS detail
    FROM checked WHERE asked AND NOT hit
    """,
)
def cross_check_misses(t: Tables) -> DataFrame:
    checked = Q.cross_check(Q.apply_formats(receipt_items(t), SCHEMA), _known_bills(t), "eway_bill", "number", "E-way Bill")
    return Q.cross_check_misses(checked).select("doc", "key", "detail")


@query(
    "document_status",
    "WITH" + _DEFICIENCIES + """
    SELECT i.doc, CASE WHEN EXISTS (SELECT 1 FROM found f WHERE f.doc = i.doc) OR i.pr = '2-HIGH' OR i.c % 4 = 1
                       THEN 'Needs Review' ELSE 'Completed' END AS status
    FROM items i
    """,
)
def document_status(t: Tables) -> DataFrame:
    """The match is in doubt for high priorities, nothing resolved for every
    fourth customer."""
    states = t.orders.select(
        F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderpriority") == "2-HIGH", "doubt").otherwise("matched").alias("status")
    )
    resolution = t.orders.select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 4 != 1).alias("resolved"))
    return Q.document_status(_docs(t), _deficiencies(t)[1], states, resolution)


@query(
    "box_canonical",
    """
    WITH b AS (
      SELECT l_orderkey, l_partkey, l_suppkey, l_quantity * 10 AS ymin, l_discount * 1000 AS xmin,
             l_quantity * 10 + l_tax * 5000 AS ymax, l_discount * 1000 + l_linenumber * 200 - 300 AS xmax FROM lineitem),
    s AS (SELECT *, CASE WHEN greatest(ymin, xmin, ymax, xmax) > 1.5 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS k,
                 CASE WHEN greatest(abs(ymin), abs(xmin), abs(ymax), abs(xmax)) > 1.5 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS k2 FROM b),
    c AS (SELECT *, least(greatest(xmin / k, 0), 1) AS x, least(greatest(ymin / k, 0), 1) AS y FROM s)
    SELECT l_orderkey, l_partkey, l_suppkey,
           CASE WHEN ok THEN round(x, 4) END AS x, CASE WHEN ok THEN round(y, 4) END AS y,
           CASE WHEN ok THEN round(w, 4) END AS w, CASE WHEN ok THEN round(h, 4) END AS h,
           round(least(greatest((xmax - xmin) / k2, 0), 1 - least(greatest(xmin / k2, 0), 1)), 4) AS lenient_w
    FROM (SELECT *, least(xmax / k - xmin / k, 1 - x) AS w, least(ymax / k - ymin / k, 1 - y) AS h,
                 xmax > xmin AND ymax > ymin AND least(xmax / k - xmin / k, 1 - x) > 0 AND least(ymax / k - ymin / k, 1 - y) > 0 AS ok
          FROM c) q
    """,
)
def box_canonical(t: Tables) -> DataFrame:
    ymin, xmin = F.col("l_quantity") * 10, F.col("l_discount") * 1000
    ymax, xmax = ymin + F.col("l_tax") * 5000, xmin + F.col("l_linenumber") * 200 - 300
    return t.lineitem.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        B.canonical_corners(ymin, xmin, ymax, xmax).alias("b"),
        B.lenient_corners(ymin, xmin, ymax, xmax)["w"].alias("lenient_w"),
    ).select("l_orderkey", "l_partkey", "l_suppkey", "b.x", "b.y", "b.w", "b.h", "lenient_w")


@query(
    "box_overlap",
    """
    WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_discount * 3 AS ax, 0.2 + l_tax AS aw, l_tax * 2 AS bx, 0.1 + l_discount AS bw FROM lineitem),
    i AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * 0.1 AS inter FROM b)
    SELECT l_orderkey, l_partkey, l_suppkey, round((inter / (aw * 0.1 + bw * 0.1 - inter))::DOUBLE, 6) AS iou,
           inter / least(aw * 0.1, bw * 0.1) >= 0.8 AS same_spot, round(least(ax, bx)::DOUBLE, 4) AS union_x,
           round(least(1 - least(ax, bx), greatest(ax + aw, bx + bw) - least(ax, bx))::DOUBLE, 4) AS union_w
    FROM i
    """,
)
def box_overlap(t: Tables) -> DataFrame:
    a = B.box(F.col("l_discount") * 3, F.lit(0.5), F.lit(0.2) + F.col("l_tax"), F.lit(0.1))
    b = B.box(F.col("l_tax") * 2, F.lit(0.5), F.lit(0.1) + F.col("l_discount"), F.lit(0.1))
    boxed = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", a.alias("a"), b.alias("b"))
    around = B.union_of(F.array("a", F.lit(None).cast(B.BOX_TYPE), "b"))
    return boxed.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.round(B.iou(F.col("a"), F.col("b")), 6).alias("iou"),
        B.same_spot(F.col("a"), F.col("b")).alias("same_spot"),
        around["x"].alias("union_x"),
        around["w"].alias("union_w"),
    )


@query(
    "box_collisions",
    """
    WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q
               FROM lineitem GROUP BY 1, 2),
    box AS (SELECT *, (p % 4) / 10 + 0.05 AS x, (s % 4) / 10 + 0.05 AS y, 0.2 + (q % 4) / 100 AS w, 0.1 + (p % 3) / 100 AS h FROM b),
    pair AS (SELECT a.doc, a.n, b.n AS m, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) *
                    greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS inter, a.w * a.h AS area_a, b.w * b.h AS area_b
             FROM box a JOIN box b ON a.doc = b.doc AND a.n < b.n)
    SELECT doc, 'f' || n AS key, 'f' || m AS other_key FROM pair WHERE inter / (area_a + area_b - inter) >= 0.85
    """,
)
def box_collisions(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q")
    )
    box = B.box(
        (F.col("p") % 4) / 10 + 0.05, (F.col("s") % 4) / 10 + 0.05, F.col("q") % 4 / 100 + 0.2, F.col("p") % 3 / 100 + 0.1
    )
    items = lines.select(
        F.col("l_orderkey").alias("doc"),
        F.concat(F.lit("f"), "l_linenumber").alias("key"),
        F.lit(None).cast("int").alias("idx"),
        box.alias("bbox"),
    )
    schema = [Q.FieldSpec(f"f{i}") for i in range(1, 8)]
    return Q.colliding_pairs(items, schema).select("doc", "key", "other_key")


@query(
    "verifier_disagreements",
    """
    SELECT l_orderkey AS doc, 'bill_numbers' AS key, CAST(l_partkey % 9 AS INTEGER) AS idx,
           'verifier: image shows ''' || l_partkey || ''' (smudged)' AS detail
    FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 9 < (
      SELECT count(DISTINCT l_linenumber) FROM lineitem x WHERE x.l_orderkey = lineitem.l_orderkey)
    UNION ALL
    SELECT l_orderkey, 'lr_number', NULL, 'verifier: image shows ''' || l_partkey || ''' (smudged)' FROM lineitem WHERE l_returnflag = 'R'
    """,
)
def verifier_disagreements(t: Tables) -> DataFrame:
    """Lines returned as N speak of an unknown field."""
    key = F.when(F.col("l_returnflag") == "A", "bill_numbers").when(F.col("l_returnflag") == "R", "lr_number").otherwise("no_such_key")
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("doc"),
        key.alias("key"),
        (F.col("l_partkey") % 9).cast("string").alias("idx"),
        F.col("l_partkey").cast("string").alias("expected"),
        F.lit("smudged").alias("reason"),
    )
    return Q.disagreements(rows, SCHEMA, receipt_items(t)).select("doc", "key", "idx", "detail")


ASKED = ["eway_bill", "series", "lr_number"]


def _patch(t: Tables) -> tuple[DataFrame, DataFrame]:
    items = Q.apply_formats(receipt_items(t), SCHEMA).where(~((F.col("key") == "eway_bill") & F.col("value").isNull()))
    kind, number = F.col("event_type"), F.col("event_id")
    key = F.when(kind == "click", "eway_bill").when(kind == "error", "series").when(kind == "purchase", "lr_number").otherwise("lr_date")
    box = lambda *sides: B.canonical_box(*[F.lit(x) for x in sides])
    disproved = box(0.3, 0.6, 0.1, 0.1)
    boxes = F.when(number % 5 == 0, box(0.0, 0.0, 0.9, 0.9)).when(number % 5 == 1, box(0.5, 0.5, 0.1, 0.1)).when(number % 5 == 2, disproved)
    repairs = t.events.select(
        F.col("user_id").alias("doc"),
        number.alias("pos"),
        key.alias("key"),
        F.lit(None).cast("string").alias("idx"),
        F.when(number % 2 == 0, F.concat(F.lit("v"), number)).alias("value"),
        F.lit(None).cast("string").alias("raw_text"),
        F.lit(None).cast("double").alias("confidence"),
        boxes.alias("bbox"),
    )
    fields = F.explode(F.array(*[F.lit(k) for k in ASKED])).alias("key")
    asked = t.orders.where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("doc"), fields, F.lit(None).cast("int").alias("idx"))
    # the crop of the third box held the value in odd documents, and got no answer in some of the others
    answer = F.when(F.col("o_orderkey") % 2 == 1, True).when(F.col("o_orderkey") % 3 != 0, False)
    outcomes = t.orders.select(
        F.col("o_orderkey").alias("doc"), fields, F.lit(None).cast("int").alias("idx"), disproved.alias("bbox"), answer.alias("contains")
    )
    return Q.patch_merge(items, repairs, asked, SCHEMA, Q.rejected_boxes(outcomes))


_PATCH = _ITEMS + """
    , old AS (
      SELECT s.doc, s.key, NULL::INTEGER AS idx, s.value,
             CASE WHEN s.key = 'lr_number' OR (s.key = 'lr_date' AND i.st <> 'F') THEN (s.doc % 8) / 10
                  WHEN s.key = 'freight_amount' AND s.doc % 7 = 0 THEN 0.1::DOUBLE END AS x
      FROM shaped s JOIN items i USING (doc) WHERE s.key <> 'eway_bill' OR s.value IS NOT NULL
      UNION ALL
      SELECT l_orderkey, 'bill_numbers', l_linenumber, 'B-' || min(l_partkey), CASE WHEN min(l_partkey) % 3 <> 0 THEN 0.1::DOUBLE END
      FROM lineitem GROUP BY l_orderkey, l_linenumber),
    repairs AS (
      SELECT user_id AS doc, event_id AS pos, CASE event_type WHEN 'click' THEN 'eway_bill' WHEN 'error' THEN 'series' ELSE 'lr_number' END AS key,
             CASE WHEN event_id % 2 = 0 THEN 'v' || event_id END AS value,
             CASE WHEN event_id % 5 = 1 THEN 0.5::DOUBLE WHEN event_id % 5 = 2 AND user_id % 2 = 1 THEN 0.3::DOUBLE END AS x
      FROM events JOIN orders ON o_orderkey = user_id AND o_orderstatus <> 'P' WHERE event_type IN ('click', 'error', 'purchase')),
    begun AS (SELECT doc, key, min(pos) FILTER (value IS NOT NULL) AS begin FROM repairs GROUP BY 1, 2),
    counted AS (
      SELECT r.* FROM repairs r JOIN begun USING (doc, key) LEFT JOIN (SELECT DISTINCT doc, key FROM old) o ON o.doc = r.doc AND o.key = r.key
      WHERE o.doc IS NOT NULL OR pos >= begin),
    fix AS (
      SELECT doc, key, arg_max(value, pos) FILTER (value IS NOT NULL) AS value, arg_max(x, pos) FILTER (x IS NOT NULL) AS x
      FROM counted GROUP BY 1, 2),
    merged AS (
      SELECT coalesce(o.doc, f.doc) AS doc, coalesce(o.key, f.key) AS key, o.idx, coalesce(f.value, o.value) AS value,
             round(coalesce(f.x, o.x), 4) AS x, f.doc IS NOT NULL AS repaired
      FROM old o FULL JOIN fix f ON f.doc = o.doc AND f.key = o.key WHERE o.doc IS NOT NULL OR f.value IS NOT NULL)
    """


@query("patch_merge", "WITH" + _PATCH + "SELECT doc, key, idx, value, x, repaired FROM merged")
def patch_merge(t: Tables) -> DataFrame:
    merged, _ = _patch(t)
    return merged.select("doc", "key", "idx", "value", F.col("bbox.x").alias("x"), "repaired")


@query(
    "patch_dropped",
    """
    SELECT user_id AS doc, CASE event_type WHEN 'click' THEN 'eway_bill' WHEN 'error' THEN 'series' WHEN 'purchase' THEN 'lr_number'
                                ELSE 'lr_date' END AS key, 'not among the asked deficiencies' AS note
    FROM events WHERE event_type NOT IN ('click', 'error', 'purchase') OR user_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    """,
)
def patch_dropped(t: Tables) -> DataFrame:
    return _patch(t)[1].select("doc", "key", "note")
