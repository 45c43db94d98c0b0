"""Replies, header and line rows, target rows, plugins.

A document is an order; its reply is JSON made from the order and its lines,
printed in the several ways a model prints it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertally.catalog.registry import Tables, query
from papertally.config import config_frame
from papertally.functions.replies import parse_reply
from papertally.operators import extraction as X
from papertally.operators.quality import FieldSpec
from papertally.plans import plugins as PL

REPLY_SCHEMA = [FieldSpec("k"), FieldSpec("type"), FieldSpec("tags", kind="array"), FieldSpec("box")]
from papertally.session import spread


def printed_replies(t: Tables) -> DataFrame:
    """One reply per event: plain, fenced, in prose, with a trailing comma, as
    a list, or unreadable."""
    kind = F.col("event_id") % 6
    k = F.get_json_object("props", "$.k")
    tags = F.when(F.col("event_id") % 4 == 0, F.lit('["a", {"value": "b", "raw_text": "B"}, null]')).when(
        F.col("event_id") % 4 == 1, F.lit('"one"')
    ).when(F.col("event_id") % 4 == 2, F.lit("[]")).otherwise("null")
    body = F.concat(
        F.lit('{"k": {"value": '), k, F.lit(', "confidence": 0.5, "bbox": [100, 100, 140, 300], "status": "Approved"}, "type": "'),
        F.col("event_type"), F.lit('", "tags": '), tags, F.lit(', "extra": 1}'),
    )
    text = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
        .when(kind == 3, F.concat(F.lit("So: "), F.regexp_replace(body, r"\}$", ", }")))
        .when(kind == 4, F.concat(F.lit("x [1, 2, ] y")))
        .otherwise(F.concat(F.lit("no json, "), F.col("event_type")))
    )
    return t.events.select(F.col("event_id").alias("doc"), text.alias("text"))


def parsed_replies(t: Tables) -> DataFrame:
    return printed_replies(t).select("doc", parse_reply(F.col("text")).alias("reply"))


@query(
    "reply_parse",
    """
    SELECT event_id AS doc, CASE WHEN event_id % 6 < 4 THEN 'object' WHEN event_id % 6 = 4 THEN 'list' ELSE 'none' END AS shape,
           CASE WHEN event_id % 6 < 4 THEN event_type END AS type
    FROM events
    """,
)
def reply_parse(t: Tables) -> DataFrame:
    shape = F.schema_of_variant("reply")
    named = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "list").otherwise("none")
    return parsed_replies(t).select("doc", named.alias("shape"), F.try_variant_get("reply", "$.type", "string").alias("type"))


@query(
    "reply_items",
    """
    WITH ok AS (SELECT event_id AS doc, event_type, json_extract_string(props, '$.k') AS k, event_id % 4 AS m FROM events WHERE event_id % 6 < 4)
    SELECT doc, 'k' AS key, CAST(NULL AS INTEGER) AS idx, k AS value, k AS raw_text, 0.5::DOUBLE AS confidence, 0.2::DOUBLE AS w FROM ok
    UNION ALL SELECT doc, 'type', NULL, event_type, event_type, NULL, NULL FROM ok
    UNION ALL SELECT doc, 'tags', 0, 'a', 'a', NULL, NULL FROM ok WHERE m = 0
    UNION ALL SELECT doc, 'tags', 1, 'b', 'B', NULL, NULL FROM ok WHERE m = 0
    UNION ALL SELECT doc, 'tags', 0, 'one', 'one', NULL, NULL FROM ok WHERE m = 1
    """,
)
def reply_items(t: Tables) -> DataFrame:
    items = X.shape_items(parsed_replies(t), REPLY_SCHEMA)
    return items.select("doc", "key", "idx", "value", "raw_text", "confidence", F.col("bbox.w").alias("w"))


@query("unknown_keys", "SELECT event_id AS doc, 'extra' AS key FROM events WHERE event_id % 6 < 4")
def unknown_keys(t: Tables) -> DataFrame:
    return X.unknown_keys(parsed_replies(t), REPLY_SCHEMA)


@query(
    "values_only",
    "SELECT event_id AS doc, 'type' AS key, CAST(NULL AS INTEGER) AS idx, event_type AS value, event_type AS raw_text FROM events WHERE event_id % 6 < 4",
)
def values_only(t: Tables) -> DataFrame:
    return X.values_only(X.shape_items(parsed_replies(t), [FieldSpec("type")]))


HEADER = [
    ("invoice_no", "Invoice No", "Data", True, None),
    ("invoice_date", "Invoice Date", "Date", True, None),
    ("total", "Total", "Currency", False, None),
    ("lines_count", "Lines", "Int", False, None),
    ("urgent", "Urgent", "Check", False, None),
    ("customer", "Customer", "Link", True, "Customer"),
    ("remarks", "Remarks", "Small Text", True, None),
]


def header(t: Tables) -> DataFrame:
    return config_frame(
        t.spark, HEADER, "fieldname string, label string, fieldtype string, required boolean, link_doctype string"
    )


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def order_replies(t: Tables) -> DataFrame:
    """Replies with ``fields`` as a list (one name twice) or as an object, and
    ``tables`` or a bare ``lines`` list."""

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'{{"fieldname": "{name}", "value": '), value, F.lit(', "page": 2, "confidence": "0.75"}'))

    def entry(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}": {{"value": '), value, F.lit(', "bbox": {"x": 0.1, "y": 0.2, "w": 0.3, "h": 0.1}}'))

    number = F.concat(F.lit("INV-"), F.col("o_orderkey"))
    values = {
        "invoice_no": _quoted(number),
        "total": _quoted(F.concat(F.lit("1,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))),
        "lines_count": _quoted(F.concat(F.col("o_custkey"), F.lit(".9"))),
        "urgent": _quoted(F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").otherwise("no")),
        "customer": _quoted(F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"))),
        "nonsense": _quoted(F.lit("x")),
    }
    twice = [field("invoice_no", _quoted(F.lit("old"))), *[field(k, v) for k, v in values.items()]]
    as_list = F.concat(F.lit('"fields": ['), F.concat_ws(", ", *twice), F.lit("]"))
    as_map = F.concat(F.lit('"fields": {'), F.concat_ws(", ", *[entry(k, v) for k, v in values.items()]), F.lit("}"))
    fields = F.when(F.col("o_orderkey") % 2 == 0, as_list).otherwise(as_map)
    line = F.concat(
        F.lit('{"description": "'), F.col("l_returnflag"), F.lit('", "item_code": "P'), F.col("l_partkey"),
        F.lit('", "qty": "'), F.col("l_quantity"), F.lit('", "rate": 2.5, "hsn": "", "gst_hsn_code": "'), F.col("l_suppkey"),
        F.lit('", "page": '), F.col("l_linenumber"), F.lit(', "uom": "Nos", "colour": "red"}'),
    )
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("text"))
    lines = t.lineitem.groupBy("l_orderkey", "l_linestatus").agg(F.array_sort(F.collect_list(place)).alias("ls"))
    texts = F.concat(F.lit('["skipped", '), F.array_join(F.transform("ls", lambda x: x["text"]), ", "), F.lit("]"))
    sides = lines.groupBy("l_orderkey").agg(
        F.max(F.when(F.col("l_linestatus") == "F", texts)).alias("f"), F.max(F.when(F.col("l_linestatus") == "O", texts)).alias("o")
    )
    empty = F.lit("[]")
    tables = F.when(
        F.col("o_orderkey") % 3 == 0, F.concat(F.lit('"lines": '), F.coalesce("f", empty))
    ).otherwise(
        F.concat(F.lit('"tables": {"other": '), F.coalesce("o", empty), F.lit(', "items": '), F.coalesce("f", empty), F.lit("}"))
    )
    # texts are made and parsed where their orders are: on all cores
    joined = spread(t.orders).join(sides, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("{"), fields, F.lit(", "), tables, F.lit("}")).alias("text"))


def _parsed_orders(t: Tables) -> DataFrame:
    return order_replies(t).select("doc", parse_reply(F.col("text")).alias("reply"))


_HEADER_ROWS = """
    WITH o AS (SELECT o_orderkey AS doc, o_custkey AS c, o_orderpriority AS p FROM orders),
    f AS (
      SELECT doc, 'invoice_no' AS fieldname, 'Data' AS fieldtype, 'INV-' || doc AS value, 'INV-' || doc AS llm_value FROM o
      UNION ALL SELECT doc, 'total', 'Currency', CAST((1000 + c % 1000)::DOUBLE AS VARCHAR), '1,' || lpad(CAST(c % 1000 AS VARCHAR), 3, '0') FROM o
      UNION ALL SELECT doc, 'lines_count', 'Int', '' || c, c || '.9' FROM o
      UNION ALL SELECT doc, 'urgent', 'Check', CASE p WHEN '1-URGENT' THEN '1' ELSE '0' END, CASE p WHEN '1-URGENT' THEN 'Yes' ELSE 'no' END FROM o
      UNION ALL SELECT doc, 'customer', 'Link', '', 'Customer#' || lpad(CAST(c * 2 AS VARCHAR), 9, '0') FROM o
      UNION ALL SELECT doc, 'invoice_date', 'Date', '', '' FROM o
      UNION ALL SELECT doc, 'remarks', 'Small Text', '', '' FROM o),
    rows AS (
      SELECT *, CASE WHEN fieldname IN ('invoice_date', 'remarks') OR doc % 2 = 1 THEN 0.0::DOUBLE ELSE 0.75::DOUBLE END AS confidence,
             CASE WHEN fieldname IN ('invoice_date', 'remarks') OR doc % 2 = 1 THEN 1 ELSE 2 END AS source_page,
             CASE WHEN fieldname NOT IN ('invoice_date', 'remarks') AND doc % 2 = 1 THEN 0.3::DOUBLE END AS w
      FROM f)
    """


@query("header_rows", _HEADER_ROWS + "SELECT doc, fieldname, fieldtype, value, llm_value, confidence, source_page, w FROM rows")
def header_rows(t: Tables) -> DataFrame:
    rows = X.header_rows(_parsed_orders(t), header(t))
    return rows.select("doc", "fieldname", "fieldtype", "value", "llm_value", "confidence", "source_page", F.col("bbox.w").alias("w"))


_LINE_ROWS = """
    l AS (
      SELECT l_orderkey AS doc, l_linestatus AS s, CASE WHEN l_orderkey % 3 = 0 OR l_linestatus = 'F' THEN 'items' ELSE 'other' END AS "table",
             CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS row_no,
             l_returnflag AS description, '' || l_suppkey AS hsn, l_quantity AS qty, 2.5::DOUBLE AS rate, l_linenumber AS source_page,
             'P' || l_partkey AS item, l_partkey
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 3 <> 0 OR l_linestatus = 'F')
    """


@query("line_rows", "WITH" + _LINE_ROWS + 'SELECT doc, "table", row_no, description, hsn, qty, rate, source_page FROM l')
def line_rows(t: Tables) -> DataFrame:
    rows = X.line_rows(_parsed_orders(t), ["items", "other"])
    return rows.select("doc", "table", "row_no", "description", "hsn", "qty", "rate", "source_page")


def _customers(t: Tables) -> DataFrame:
    return t.customer.select(F.lit("Customer").alias("doctype"), F.col("c_name").alias("name"))


def _extracted(t: Tables) -> tuple[DataFrame, DataFrame]:
    plugin = PL.get_plugin("Order")
    return PL.extract_document_rows(order_replies(t), plugin, header(t), ["items", "other"], _customers(t))


@query(
    "link_match",
    _HEADER_ROWS + """
    SELECT doc, fieldname, CASE WHEN c_name IS NOT NULL THEN c_name ELSE value END AS value, c_name AS matched_value,
           CASE WHEN c_name IS NOT NULL THEN 'exact' END AS match_method
    FROM rows LEFT JOIN customer ON fieldname = 'customer' AND c_name = llm_value
    """,
)
def link_match(t: Tables) -> DataFrame:
    return _extracted(t)[0].select("doc", "fieldname", "value", "matched_value", "match_method")


@query(
    "build_header",
    _HEADER_ROWS + """
    SELECT o.doc, 'INV-' || o.doc AS invoice_no, CAST((1000 + c % 1000)::DOUBLE AS VARCHAR) AS total, '' || c AS lines_count,
           CASE p WHEN '1-URGENT' THEN '1' ELSE '0' END AS urgent, c_name AS customer, NULL AS remarks
    FROM o LEFT JOIN customer ON c_custkey = o.c * 2
    """,
)
def build_header(t: Tables) -> DataFrame:
    return X.build_header(_extracted(t)[0], ["invoice_no", "total", "lines_count", "urgent", "customer", "remarks"])


def _reviewed_lines(t: Tables) -> DataFrame:
    """Lines matched to their item unless their number is even; some are free
    text, some rejected."""
    lines = _extracted(t)[1]
    state = F.when(F.col("row_no") % 5 == 0, "Rejected").when(F.col("row_no") % 3 == 0, "Free Text").otherwise("Confirmed")
    return lines.withColumn("resolution_status", state).withColumn(
        "matched_item", F.when(F.col("row_no") % 2 == 1, F.concat(F.lit("I"), "row_no"))
    )


@query(
    "build_child_rows",
    "WITH" + _LINE_ROWS + """
    , live AS (SELECT *, CASE WHEN row_no % 2 = 1 AND row_no % 3 <> 0 THEN 'I' || row_no END AS matched FROM l WHERE row_no % 5 <> 0)
    SELECT doc, "table", row_no, 'qty' AS "column", CAST(qty AS VARCHAR) AS value FROM live
    UNION ALL SELECT doc, "table", row_no, 'rate', '2.5' FROM live
    UNION ALL SELECT doc, "table", row_no, 'uom', 'Nos' FROM live WHERE "table" = 'items'
    UNION ALL SELECT doc, "table", row_no, 'item_code', matched FROM live WHERE matched IS NOT NULL AND "table" = 'items'
    UNION ALL SELECT doc, "table", row_no, 'item_name', description FROM live WHERE matched IS NULL AND "table" = 'items'
    """,
)
def build_child_rows(t: Tables) -> DataFrame:
    columns = [
        ("items", "qty", "Float"), ("items", "rate", "Currency"), ("items", "uom", "Data"),
        ("items", "item_code", "Link"), ("items", "item_name", "Data"),
        ("other", "qty", "Float"), ("other", "rate", "Currency"),
    ]
    known = config_frame(t.spark, columns, "table string, column string, fieldtype string")
    links = config_frame(t.spark, [("items", "item_code")], "table string, link_field string")
    return X.build_child_rows(_reviewed_lines(t), known, links)


@query(
    "child_rows_long",
    """
    SELECT doc_id AS doc, 'body' AS "column", n_chars AS n, text <> '' AS filled FROM documents WHERE text <> ''
    UNION ALL SELECT doc_id, 'qty', CAST(length(CAST(n_chars::DOUBLE AS VARCHAR)) AS BIGINT), true FROM documents WHERE n_chars > 0
    """,
)
def child_rows_long(t: Tables) -> DataFrame:
    """A line per document that carries its whole text; the quantity comes after it."""
    entry = F.struct(F.concat(F.lit("|"), "text", F.lit("|")).alias("body"), F.col("n_chars").alias("qty"))
    reply = F.to_json(F.struct(F.struct(F.array(entry).alias("items")).alias("tables")))
    replies = t.documents.where("text <> ''").select(F.col("doc_id").alias("doc"), F.parse_json(reply).alias("reply"))
    lines = X.line_rows(replies, ["items"]).withColumn("matched_item", F.lit(None).cast("string"))
    known = config_frame(t.spark, [("items", "body", "Text"), ("items", "qty", "Float")], "table string, column string, fieldtype string")
    cells = X.build_child_rows(lines, known, config_frame(t.spark, [], "table string, link_field string"))
    around = F.when(F.col("column") == "body", 2).otherwise(0)
    return cells.select("doc", "column", (F.length("value") - around).cast("bigint").alias("n"), (F.col("value") != "").alias("filled"))


def _meta(t: Tables) -> DataFrame:
    """Parts as fields of the table their brand names."""
    size = F.col("p_size") % 6
    kind = (
        F.when(size == 0, "Data").when(size == 1, "Link").when(size == 2, "Select").when(size == 3, "Table").when(size == 4, "Date").otherwise("Section Break")
    )
    return t.part.select(
        F.col("p_brand").alias("parent"),
        F.concat(F.when(F.col("p_partkey") % 11 == 0, "_f").otherwise("f"), "p_partkey").alias("fieldname"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).otherwise("").alias("label"),
        kind.alias("fieldtype"),
        F.when(size == 2, F.concat(F.lit("\n"), F.col("p_type"), F.lit("\n\n"), F.col("p_name"))).otherwise(F.col("p_type")).alias("options"),
        (F.col("p_size") % 2).alias("reqd"),
        F.when(F.col("p_type") == "PROMO", 1).otherwise(0).alias("hidden"),
        (F.col("p_partkey") % 13 == 0).cast("int").alias("read_only"),
        F.when(F.col("p_partkey") % 17 == 0, 1).alias("is_virtual"),
        F.col("p_partkey").alias("idx"),
    )


_META = """
    WITH usable AS (
      SELECT p_brand AS parent, p_partkey AS idx, CASE WHEN p_partkey % 11 = 0 THEN '_f' ELSE 'f' END || p_partkey AS fieldname,
             CASE WHEN p_partkey % 7 <> 0 THEN p_name ELSE 'f' || p_partkey END AS label, p_size % 6 AS m, p_size % 2 = 1 AS required, p_type, p_name
      FROM part WHERE p_size % 6 IN (0, 1, 2, 4) AND p_type <> 'PROMO' AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 11 <> 0)
    """


@query(
    "header_fields",
    _META + """
    SELECT parent, fieldname, label, ['Data', 'Link', 'Select', '', 'Date'][m + 1] AS fieldtype, required,
           CASE WHEN m = 2 THEN p_type || '|' || p_name END AS choices, CASE WHEN m = 1 THEN p_type END AS link_doctype
    FROM usable
    """,
)
def header_fields(t: Tables) -> DataFrame:
    fields = X.header_fields(_meta(t))
    joined = F.when(F.col("choices").isNotNull(), F.array_join("choices", "|"))
    return fields.select("parent", "fieldname", "label", "fieldtype", "required", joined.alias("choices"), "link_doctype")


@query(
    "child_columns",
    _META + """
    SELECT parent, fieldname, col_no FROM (
      SELECT parent, fieldname, CAST(row_number() OVER (PARTITION BY parent ORDER BY idx) AS INTEGER) AS col_no FROM usable) q
    WHERE col_no <= 20
    """,
)
def child_columns(t: Tables) -> DataFrame:
    return X.child_columns(_meta(t), X.COLUMN_LIMIT).select("parent", "fieldname", "col_no")


@query(
    "primary_link",
    """
    SELECT p_brand AS parent, arg_min(CASE WHEN p_partkey % 11 = 0 THEN '_f' ELSE 'f' END || p_partkey, p_partkey) AS link_field
    FROM part WHERE p_size % 6 = 1 AND p_type <> 'PROMO' AND p_partkey % 17 <> 0 GROUP BY 1
    """,
)
def primary_link(t: Tables) -> DataFrame:
    return X.primary_link(_meta(t))


def _books(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.col("s_suppkey").alias("name"),
        F.col("s_nationkey").alias("target_doctype"),
        (F.col("s_suppkey") % 3).alias("priority"),
        F.col("s_acctbal").alias("modified"),
        (F.col("s_suppkey") % 5 != 0).cast("int").alias("enabled"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("T"), F.col("s_suppkey") % 4)).otherwise("").alias("line_table"),
    )


@query(
    "rule_book_tables",
    """
    WITH books AS (
      SELECT s_suppkey AS name, s_nationkey AS target, CASE WHEN s_suppkey % 2 = 0 THEN 'T' || (s_suppkey % 4) END AS line_table,
             CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 DESC, s_acctbal, s_suppkey) AS INTEGER) AS book_ord
      FROM supplier WHERE s_suppkey % 5 <> 0),
    declared AS (
      SELECT target, 'T' || (l_linenumber + l_suppkey % 4) AS tab, book_ord, min(l_linenumber) AS pos
      FROM books JOIN lineitem ON l_suppkey = name GROUP BY 1, 2, 3
      UNION ALL SELECT target, line_table, book_ord, 2147483647 FROM books WHERE line_table IS NOT NULL)
    SELECT target AS target_doctype, tab AS "table", min(book_ord) AS book_ord FROM declared GROUP BY 1, 2
    """,
)
def rule_book_tables(t: Tables) -> DataFrame:
    tables = t.lineitem.select(
        F.col("l_suppkey").alias("book"),
        F.col("l_linenumber").alias("idx"),
        F.concat(F.lit("T"), F.col("l_linenumber") + F.col("l_suppkey") % 4).alias("table_fieldname"),
        F.lit(None).cast("string").alias("label"),
    ).distinct()
    return X.rule_book_tables(_books(t), tables).select("target_doctype", "table", "book_ord")


def _rules(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat(F.lit("Brand#"), F.col("l_suppkey") % 25).alias("target_doctype"),
        F.concat(F.lit("f"), F.col("l_partkey")).alias("fieldname"),
        F.when(F.col("l_returnflag") == "A", "own").otherwise("").alias("label"),
    )


@query(
    "invalid_rule_fields",
    """
    SELECT 'Brand#' || (l_suppkey % 25) AS target_doctype, 'f' || l_partkey AS fieldname FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_partkey % 11 <> 0 AND p_brand = 'Brand#' || (l_suppkey % 25))
    """,
)
def invalid_rule_fields(t: Tables) -> DataFrame:
    return X.invalid_rule_fields(_rules(t), _meta(t)).select("target_doctype", "fieldname")


@query(
    "labelled_rules",
    """
    SELECT 'Brand#' || (l_suppkey % 25) AS target_doctype, 'f' || l_partkey AS fieldname,
           CASE WHEN l_returnflag = 'A' THEN 'own' WHEN p_partkey IS NOT NULL THEN CASE WHEN p_partkey % 7 <> 0 THEN p_name ELSE '' END END AS label
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 11 <> 0 AND p_brand = 'Brand#' || (l_suppkey % 25)
    """,
)
def labelled_rules(t: Tables) -> DataFrame:
    return X.labelled_rules(_rules(t), _meta(t)).select("target_doctype", "fieldname", "label")


def _lines(t: Tables) -> DataFrame:
    first = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("qty"), F.min("l_partkey").alias("p"))
    return first.select(
        F.col("l_orderkey").alias("doc"),
        F.col("l_linenumber").alias("row_no"),
        F.lit("text").alias("description"),
        F.lit("Nos").alias("uom"),
        "qty",
        F.lit(1.0).alias("rate"),
        F.lit(2.0).alias("amount"),
        F.when(F.col("p") % 2 == 0, F.col("p").cast("string")).alias("matched_item"),
        F.lit("Unmatched").alias("resolution_status"),
        F.lit(None).cast("string").alias("match_method"),
        F.lit(None).cast("double").alias("match_confidence"),
    )


@query(
    "line_events",
    """
    WITH lines AS (SELECT l_orderkey AS doc, l_linenumber AS row_no, min(l_quantity) AS qty, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
    ev AS (
      SELECT user_id AS doc, CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 + 1 AS row_no, ts, event_id, value,
             CASE event_type WHEN 'click' THEN 'confirm' WHEN 'error' THEN 'free_text' ELSE 'edit' END AS kind FROM events),
    last AS (
      SELECT doc, row_no, arg_max(kind, ts) FILTER (kind <> 'edit') AS kind, arg_max('I' || event_id, ts) FILTER (kind <> 'edit') AS item,
             arg_max(value, ts) FILTER (kind = 'edit') AS qty, bool_or(kind = 'confirm') AS once FROM ev GROUP BY 1, 2)
    SELECT l.doc, l.row_no, coalesce(e.qty, l.qty) AS qty,
           CASE e.kind WHEN 'confirm' THEN e.item WHEN 'free_text' THEN NULL ELSE CASE WHEN l.p % 2 = 0 THEN '' || l.p END END AS matched_item,
           CASE e.kind WHEN 'confirm' THEN 'Confirmed' WHEN 'free_text' THEN 'Free Text' ELSE 'Unmatched' END AS resolution_status,
           CASE WHEN e.once THEN 'user-confirmed' END AS match_method, CASE WHEN e.once THEN 1.0::DOUBLE END AS match_confidence
    FROM lines l LEFT JOIN last e ON e.doc = l.doc AND e.row_no = l.row_no
    """,
)
def line_events(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "confirm").when(F.col("event_type") == "error", "free_text").otherwise("edit")
    events = t.events.select(
        F.col("user_id").alias("doc"),
        (F.get_json_object("props", "$.k").cast("int") % 7 + 1).alias("row_no"),
        F.col("ts").alias("at"),
        kind.alias("kind"),
        F.concat(F.lit("I"), "event_id").alias("value"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("uom"),
        F.col("value").alias("qty"),
        F.lit(None).cast("double").alias("rate"),
        F.lit(None).cast("double").alias("amount"),
    )
    return X.apply_line_events(_lines(t), events).select(
        "doc", "row_no", "qty", "matched_item", "resolution_status", "match_method", "match_confidence"
    )


@query(
    "line_counts",
    """
    SELECT doc, count(*) FILTER (p % 2 = 0) AS resolved, count(*) FILTER (p % 2 <> 0) AS unresolved
    FROM (SELECT l_orderkey AS doc, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) q GROUP BY doc
    """,
)
def line_counts(t: Tables) -> DataFrame:
    return X.line_counts(_lines(t))


@query(
    "field_edits",
    """
    WITH RECURSIVE edits AS (
      SELECT user_id AS doc, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS fieldname,
             CASE event_type WHEN 'click' THEN 'P' WHEN 'error' THEN NULL ELSE 'new' || event_id END AS v,
             CASE event_type WHEN 'view' THEN 'Rejected' END AS s, '' || event_id AS u, ts
      FROM events),
    e AS (SELECT *, row_number() OVER (PARTITION BY doc, fieldname ORDER BY ts) AS n FROM edits),
    rows AS (SELECT o_orderkey AS doc, 'o_orderstatus' AS fieldname, o_orderstatus AS value FROM orders
             UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders),
    steps AS (
      SELECT doc, fieldname, value, 'Pending' AS status, NULL::VARCHAR AS edited_by, NULL::TIMESTAMP AS edited_on, 0::BIGINT AS n FROM rows
      UNION ALL
      SELECT x.doc, x.fieldname, coalesce(e.v, x.value),
             CASE WHEN e.s IS NOT NULL THEN e.s WHEN e.v <> x.value THEN 'Edited' ELSE x.status END,
             CASE WHEN e.v <> x.value THEN e.u ELSE x.edited_by END, CASE WHEN e.v <> x.value THEN e.ts ELSE x.edited_on END, e.n
      FROM steps x JOIN e ON e.doc = x.doc AND e.fieldname = x.fieldname AND e.n = x.n + 1)
    SELECT doc, fieldname, value, status, edited_by, edited_on FROM steps
    QUALIFY row_number() OVER (PARTITION BY doc, fieldname ORDER BY n DESC) = 1
    """,
)
def field_edits(t: Tables) -> DataFrame:
    entries = F.array(
        *[F.struct(F.lit(f).alias("fieldname"), F.col(f).alias("value")) for f in ("o_orderstatus", "o_orderpriority")]
    )
    rows = t.orders.select(F.col("o_orderkey").alias("doc"), F.inline(entries)).withColumn("status", F.lit("Pending"))
    value = F.when(F.col("event_type") == "click", "P").when(F.col("event_type") != "error", F.concat(F.lit("new"), "event_id"))
    even = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    edits = t.events.select(
        F.col("user_id").alias("doc"),
        F.when(even, "o_orderstatus").otherwise("o_orderpriority").alias("fieldname"),
        F.col("ts").alias("at"),
        value.alias("value"),
        F.when(F.col("event_type") == "view", "Rejected").alias("status"),
        F.col("event_id").cast("string").alias("user"),
    )
    return X.apply_field_edits(rows, edits).select("doc", "fieldname", "value", "status", "edited_by", "edited_on")


@query(
    "provenance",
    """
    WITH l AS (
      SELECT l_orderkey AS doc, l_linenumber AS n, arg_max({'x': l_quantity / 100, 'p': l_partkey % 4}, (l_partkey, l_suppkey)) AS last
      FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
    SELECT doc, 'line' AS part, 'items' AS "table", '' || n AS entry, last.x AS x, last.p AS page FROM l
    UNION ALL SELECT o_orderkey, 'field', '', o_orderstatus, 0.5::DOUBLE, 1 FROM orders WHERE o_orderpriority <> '5-LOW'
    """,
)
def provenance(t: Tables) -> DataFrame:
    """Duplicate line numbers: the one with the largest part counts."""
    box = F.struct((F.col("l_quantity") / 100).alias("x"))
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("doc"),
        F.lit("items").alias("table"),
        F.col("l_linenumber").alias("row_no"),
        F.when(F.col("l_returnflag") != "N", box).alias("bbox"),
        (F.col("l_partkey") % 4).alias("source_page"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("pos"),
    )
    rows = t.orders.select(
        F.col("o_orderkey").alias("doc"),
        F.lit(0).alias("pos"),
        F.col("o_orderstatus").alias("fieldname"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.struct(F.lit(0.5).alias("x"))).alias("bbox"),
        F.lit(1).cast("bigint").alias("source_page"),
    )
    return X.provenance(rows, lines).select("doc", "part", "table", "entry", "bbox.x", "page")
