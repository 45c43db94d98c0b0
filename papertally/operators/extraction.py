"""From replies to items, header rows, line rows and target rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertally.functions.boxes import box_from_json
from papertally.functions.numbers import cint, coerce_value, flt, try_double
from papertally.functions.positions import keep_first, keep_last, top_rows
from papertally.functions.text import blank_to_null
from papertally.operators.quality import FieldSpec
from papertally.session import written

# Field types that can be extracted, and those that hold links.
EXTRACTABLE_TYPES = [
    "Data", "Small Text", "Text", "Long Text", "Text Editor", "Select", "Link", "Dynamic Link",
    "Date", "Datetime", "Time", "Int", "Float", "Currency", "Percent", "Check", "Phone",
]
LINK_TYPES = ["Link", "Dynamic Link"]

# Lengths of the fields that texts may be cut to on request, and
# the number of columns of a child table that a form shows.
FIELD_LENGTHS = {"llm_raw_text": 1000, "description": 1000, "supplier_code": 140, "hsn": 30, "uom": 50}
COLUMN_LIMIT = 20

# Entries of a line that describe it and are no columns.
LINE_NOTES = ["page", "bbox", "raw_text", "confidence"]


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _is_object(v: Column) -> Column:
    """Is a VARIANT an object? Its entries are not looked at, unlike for a whole schema."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def _shortened(rows: DataFrame, lengths: Mapping[str, int] | None) -> DataFrame:
    """Texts cut to the lengths given for their columns; without any they stay whole."""
    cuts = {c: F.substring(c, 1, n) for c, n in (lengths or {}).items() if c in rows.columns}
    return rows.withColumns(cuts) if cuts else rows


def _indexed(key: str) -> Callable[[Column, Column], Column]:
    return lambda v, i: F.struct(F.lit(key).alias("key"), i.cast("int").alias("idx"), v.alias("item"))


def _of_table(table: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(table).alias("table"), v.alias("item"))


def shape_items(replies: DataFrame, schema: Sequence[FieldSpec]) -> DataFrame:
    """(doc, key, idx, value, raw_text, confidence, bbox) for the schema keys.

    ``replies``: (doc, reply) with ``reply`` a VARIANT object. Other keys are
    ignored, also inside an item. A lone value under a list key becomes a list
    of one, null entries vanish, and a bare value becomes an item of its own.
    """
    def raw(spec: FieldSpec) -> Column:
        found = F.try_variant_get("reply", f"$.{spec.key}", "variant")
        return F.get(F.filter(F.array(found), lambda v: ~F.is_variant_null(v)), F.lit(0))

    given = replies.select("doc", *[raw(s).alias(f"_r{i}") for i, s in enumerate(schema)])
    entries = []
    for i, spec in enumerate(schema):
        present = F.col(f"_r{i}")
        if spec.kind == "array":
            text = F.to_json(present)
            listed = F.try_variant_get(present, "$", "array<variant>")
            lone = F.when(~text.isin("{}", '""', "false", "0", "0.0"), F.array(present))
            kept = F.filter(F.coalesce(listed, lone), lambda v: v.isNotNull() & ~F.is_variant_null(v))
            entries.append(F.transform(kept, _indexed(spec.key)))
        else:
            one = F.struct(F.lit(spec.key).alias("key"), F.lit(None).cast("int").alias("idx"), present.alias("item"))
            entries.append(F.when(present.isNotNull(), F.array(one)))
    empty = F.expr("CAST(array() AS array<struct<key:string,idx:int,item:variant>>)")
    rows = given.select("doc", F.inline(F.concat(*[F.coalesce(e, empty) for e in entries])))
    # an object has an entry for every path; anything else is a bare value
    parts = rows.select(
        "doc",
        "key",
        "idx",
        _is_object(F.col("item")).alias("_object"),
        _text(F.col("item"), "$").alias("_bare"),
        _text(F.col("item"), "$.value").alias("_value"),
        _text(F.col("item"), "$.raw_text").alias("_raw"),
        _text(F.col("item"), "$.confidence").alias("_confidence"),
        F.to_json(F.try_variant_get("item", "$.bbox", "variant")).alias("_bbox"),
    )
    value = F.when(F.col("_object"), F.col("_value")).otherwise(F.col("_bare"))
    return parts.select(
        "doc",
        "key",
        "idx",
        value.alias("value"),
        F.coalesce(F.when(F.col("_object"), blank_to_null(F.col("_raw"))), value).alias("raw_text"),
        F.when(F.col("_object"), try_double(F.col("_confidence"))).alias("confidence"),
        F.when(F.col("_object"), box_from_json(F.col("_bbox"))).alias("bbox"),
    )


def unknown_keys(replies: DataFrame, schema: Sequence[FieldSpec]) -> DataFrame:
    """(doc, key): top-level reply keys that the schema does not name."""
    keys = F.map_keys(F.try_variant_get("reply", "$", "map<string,variant>"))
    extra = F.array_except(keys, F.array(*[F.lit(s.key) for s in schema]))
    return replies.select("doc", F.explode(extra).alias("key"))


def values_only(items: DataFrame) -> DataFrame:
    return items.select("doc", "key", "idx", "value", "raw_text")


def header_fields(meta: DataFrame) -> DataFrame:
    """Fields of a table that can be extracted, with their choices.

    ``meta``: (parent, fieldname, label, fieldtype, options, reqd, hidden,
    read_only, is_virtual, idx).
    """
    usable = (
        F.col("fieldtype").isin(EXTRACTABLE_TYPES)
        & (F.coalesce("hidden", F.lit(0)) == 0)
        & (F.coalesce("read_only", F.lit(0)) == 0)
        & (F.coalesce("is_virtual", F.lit(0)) == 0)
        & ~F.col("fieldname").startswith("_")
    )
    choices = F.filter(F.split("options", "\n"), lambda o: o != "")
    return meta.where(usable).select(
        "parent",
        "idx",
        "fieldname",
        F.coalesce(blank_to_null(F.col("label")), "fieldname").alias("label"),
        "fieldtype",
        (F.coalesce("reqd", F.lit(0)) != 0).alias("required"),
        F.when(F.col("fieldtype") == "Select", choices).alias("choices"),
        F.when(F.col("fieldtype") == "Link", blank_to_null(F.col("options"))).alias("link_doctype"),
    )


def child_columns(meta: DataFrame, limit: int | None = None) -> DataFrame:
    """The extractable columns of each child table with their place, by field
    order; with ``limit`` the first ones."""
    return top_rows(header_fields(meta), ["parent"], [F.col("idx")], limit, "col_no")


def primary_link(meta: DataFrame) -> DataFrame:
    """(parent, link_field): the first visible, stored Link column."""
    shown = (F.coalesce("hidden", F.lit(0)) == 0) & (F.coalesce("is_virtual", F.lit(0)) == 0)
    links = meta.where((F.col("fieldtype") == "Link") & shown)
    return links.groupBy("parent").agg(F.min_by("fieldname", F.struct("idx", "fieldname")).alias("link_field"))


def rule_books(books: DataFrame) -> DataFrame:
    """Enabled rule books of each target with their rank (priority, then age)."""
    w = Window.partitionBy("target_doctype").orderBy(F.col("priority").desc(), F.col("modified").asc(), F.col("name"))
    return books.where(F.col("enabled") == 1).withColumn("book_ord", F.row_number().over(w))


def rule_book_tables(books: DataFrame, tables: DataFrame) -> DataFrame:
    """(target_doctype, table, label, book_ord, pos): declared child tables, the
    first declaration of each; a book's single ``line_table`` comes after its list.

    ``tables``: (book, idx, table_fieldname, label).
    """
    ranked = rule_books(books)
    listed = ranked.join(tables, ranked["name"] == tables["book"]).select(
        "target_doctype", F.col("table_fieldname").alias("table"), "label", "book_ord", F.col("idx").alias("pos")
    )
    single = ranked.select(
        "target_doctype",
        F.col("line_table").alias("table"),
        F.lit(None).cast("string").alias("label"),
        "book_ord",
        F.lit(2**31 - 1).alias("pos"),
    )
    named = listed.unionByName(single).where(F.coalesce("table", F.lit("")) != "")
    return keep_first(named, ["target_doctype", "table"], F.struct("book_ord", "pos"))


def invalid_rule_fields(rules: DataFrame, meta: DataFrame) -> DataFrame:
    """Rules (target_doctype, fieldname, ...) that name no field of the target."""
    fields = meta.select(F.col("parent").alias("target_doctype"), "fieldname")
    return rules.where(F.coalesce("fieldname", F.lit("")) != "").join(fields, ["target_doctype", "fieldname"], "left_anti")


def labelled_rules(rules: DataFrame, meta: DataFrame) -> DataFrame:
    """Rules with a missing label filled from the field's own."""
    fields = meta.select(F.col("parent").alias("target_doctype"), "fieldname", F.col("label").alias("_label"))
    joined = rules.join(fields, ["target_doctype", "fieldname"], "left")
    return joined.withColumn("label", F.coalesce(blank_to_null(F.col("label")), "_label")).drop("_label")


def _entry(pos: Column, fieldname: Column, item: Column) -> Column:
    return F.struct(pos.cast("int").alias("pos"), fieldname.alias("fieldname"), item.alias("item"))


def reply_fields(replies: DataFrame, demanded: Column | None = None) -> DataFrame:
    """(doc, pos, fieldname, item): the ``fields`` part of each reply, given as
    a list of objects or as an object by field name; the last one of a name
    wins and keeps the first position.

    ``demanded``, an array of further entries at position -1 without an item,
    adds the fields a reply lacks in the same aggregate.
    """
    listed = F.try_variant_get("reply", "$.fields", "array<variant>")
    named = F.try_variant_get("reply", "$.fields", "map<string,variant>")
    from_list = F.transform(listed, lambda v, i: _entry(i, F.try_variant_get(v, "$.fieldname", "string"), v))
    from_map = F.transform(F.map_entries(named), lambda e, i: _entry(i, e["key"], e["value"]))
    none = F.expr("CAST(array() AS array<struct<pos:int,fieldname:string,item:variant>>)")
    given = F.filter(
        F.coalesce(from_list, from_map, none),
        lambda e: (F.coalesce(e["fieldname"], F.lit("")) != "") & _is_object(e["item"]),
    )
    if demanded is not None:
        given = F.concat(given, demanded)
    rows = replies.select("doc", F.inline(given))
    # variants cannot be compared, but they can be carried by max_by
    return rows.groupBy("doc", "fieldname").agg(
        F.min(F.when(F.col("pos") >= 0, F.col("pos"))).alias("pos"), F.max_by("item", "pos").alias("item")
    )


def header_rows(replies: DataFrame, header: DataFrame, lengths: Mapping[str, int] | None = None) -> DataFrame:
    """Field rows of each document: known fields of the reply, and required
    fields it lacks. ``header``: (fieldname, label, fieldtype, required). With ``lengths``
    (such as ``FIELD_LENGTHS``) texts are cut."""
    # the header of a target is a configuration table of a few dozen fields
    absent = _entry(F.lit(-1), F.col("fieldname"), F.lit(None).cast("variant"))
    demanded = header.agg(F.collect_list(F.when(F.col("required"), absent)).alias("d")).scalar()
    rows = reply_fields(replies, demanded).join(header, "fieldname")
    parts = rows.select(
        "doc",
        "pos",
        "fieldname",
        "label",
        "fieldtype",
        _text(F.col("item"), "$.value").alias("_value"),
        _text(F.col("item"), "$.raw_text").alias("_raw"),
        _text(F.col("item"), "$.confidence").alias("_confidence"),
        cint(_text(F.col("item"), "$.page")).alias("_page"),
        F.to_json(F.try_variant_get("item", "$.bbox", "variant")).alias("_bbox"),
    )
    coerced = F.coalesce(coerce_value(F.col("fieldtype"), F.col("_value")), F.lit(""))
    shaped = parts.select(
        "doc",
        "pos",
        "fieldname",
        "label",
        "fieldtype",
        F.when(F.col("fieldtype").isin(LINK_TYPES), F.lit("")).otherwise(coerced).alias("value"),
        F.coalesce("_value", F.lit("")).alias("llm_value"),
        F.coalesce("_raw", F.lit("")).alias("llm_raw_text"),
        flt(F.col("_confidence")).alias("confidence"),
        box_from_json(F.col("_bbox"), strict=False).alias("bbox"),
        F.when(F.col("_page") == 0, F.lit(1)).otherwise(F.col("_page")).alias("source_page"),
        F.lit("Pending").alias("status"),
    )
    return _shortened(shaped, lengths)


def line_rows(replies: DataFrame, tables: Sequence[str], lengths: Mapping[str, int] | None = None) -> DataFrame:
    """Line rows of each document, numbered over all its tables in order.

    The numbers come from the position inside the reply, so no window over a
    document is needed. A reply with a bare ``lines`` list fills the first
    table. Entries that are no objects are skipped and not counted. ``raw_json``
    is the whole entry; with ``lengths`` (such as ``FIELD_LENGTHS``) other texts are cut.
    """
    has_tables = F.try_variant_get("reply", "$.tables", "struct<>").isNotNull()
    parts = []
    for i, table in enumerate(tables):
        own = F.try_variant_get("reply", f"$.tables.{table}", "array<variant>")
        if i == 0:
            legacy = F.try_variant_get("reply", "$.lines", "array<variant>")
            own = F.when(has_tables, own).otherwise(legacy)
        objects = F.filter(own, _is_object)
        parts.append(
            F.coalesce(
                F.transform(objects, _of_table(table)),
                F.array().cast("array<struct<table:string,item:variant>>"),
            )
        )
    rows = replies.select("doc", F.posexplode(F.concat(*parts)).alias("_n", "_l")).select(
        "doc", (F.col("_n") + 1).alias("row_no"), "_l.*"
    )

    def text(*names: str) -> Column:
        texts = [blank_to_null(_text(F.col("item"), f"$.{n}")) for n in names]
        return F.coalesce(*texts, F.lit(""))

    rows = rows.withColumn("_page", cint(_text(F.col("item"), "$.page"))).withColumn(
        "_bbox", F.to_json(F.try_variant_get("item", "$.bbox", "variant"))
    )
    page = F.col("_page")
    shaped = rows.select(
        "doc",
        "table",
        "row_no",
        text("description", "item_name").alias("description"),
        text("supplier_code").alias("supplier_code"),
        text("hsn", "gst_hsn_code").alias("hsn"),
        flt(_text(F.col("item"), "$.qty")).alias("qty"),
        text("uom").alias("uom"),
        flt(_text(F.col("item"), "$.rate")).alias("rate"),
        flt(_text(F.col("item"), "$.amount")).alias("amount"),
        F.to_json("item").alias("raw_json"),
        F.when(page == 0, F.lit(1)).otherwise(page).alias("source_page"),
        box_from_json(F.col("_bbox"), strict=False).alias("bbox"),
        F.lit("Unmatched").alias("resolution_status"),
    )
    return _shortened(shaped, lengths)


def match_links(rows: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """Header rows with exact link matches filled in.

    ``links``: (fieldname, link_doctype); ``targets``: (doctype, name) of all
    linked tables together, so every link field resolves in one join.
    """
    printed = F.coalesce(blank_to_null(F.col("llm_value")), blank_to_null(F.col("value")))
    known = targets.select(F.col("doctype").alias("link_doctype"), F.col("name").alias("_printed")).distinct()
    joined = (
        rows.join(links, "fieldname", "left")
        .withColumn("_printed", printed)
        .join(known.withColumn("_hit", F.lit(True)), ["link_doctype", "_printed"], "left")
    )
    rest = [c for c in rows.columns if c != "value"]
    return joined.select(
        *rest,
        F.when(F.col("_hit"), F.col("_printed")).otherwise(F.col("value")).alias("value"),
        F.when(F.col("_hit"), F.col("_printed")).alias("matched_value"),
        F.when(F.col("_hit"), F.lit("exact")).alias("match_method"),
    )


def build_header(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per document with a column per field; rejected and empty values
    are left out. Every field is one aggregate of a single ``groupBy``."""
    kept = rows.where((F.coalesce("status", F.lit("")) != "Rejected") & (F.coalesce("value", F.lit("")) != ""))
    typed = coerce_value(F.col("fieldtype"), F.col("value"))
    aggs = [F.max(F.when(F.col("fieldname") == f, typed)).alias(f) for f in fields]
    return kept.groupBy("doc").agg(*aggs)


def build_child_rows(
    lines: DataFrame, columns: DataFrame, links: DataFrame, default_table: Column | None = None
) -> DataFrame:
    """(doc, table, row_no, column, value): the cells of the child rows.

    ``columns``: (table, column, fieldtype) of the child tables; ``links``:
    (table, link_field). Cells of unknown or link columns and empty ones are
    left out; the link column takes the matched record unless the line is free
    text; without one, ``item_name`` falls back on the description.

    The cells of a line are made in one pass. Where a table has an ``item_name``
    they are written once (an action): descriptions are then read beside entries.
    """
    own = blank_to_null(F.col("table"))
    table = own if default_table is None else F.coalesce(own, default_table)
    named = columns.groupBy("table").agg(F.coalesce(F.bool_or(F.col("column") == "item_name"), F.lit(False)).alias("_named"))
    linked = links.groupBy("table").agg(F.collect_list(F.struct("link_field")).alias("_links"))
    live = (
        lines.where(F.coalesce("resolution_status", F.lit("")) != "Rejected")
        .withColumn("table", table)
        .join(named, "table")
        .join(linked, "table", "left")
    )

    def cell(part: str, column: Column, text: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), column.alias("column"), text.alias("text"))

    entries = F.transform(F.map_entries(F.from_json("raw_json", "map<string,string>")), lambda e: cell("entry", e["key"], e["value"]))
    # a line of a table without a link is left to its description
    no_link = F.array(F.struct(F.lit(None).cast("string").alias("link_field")))
    matched = F.when(F.coalesce("resolution_status", F.lit("")) != "Free Text", blank_to_null(F.col("matched_item")))
    described = F.when(F.col("_named"), cell("fallback", F.lit("item_name"), F.col("description")))
    rest = F.transform(
        F.coalesce("_links", no_link),
        lambda x: F.when(matched.isNotNull() & x["link_field"].isNotNull(), cell("link", x["link_field"], matched)).otherwise(described),
    )
    none = F.array().cast("array<struct<part:string,column:string,text:string>>")
    given = live.select("doc", "table", "row_no", F.inline(F.concat(F.coalesce(entries, none), rest))).where(
        (F.coalesce("text", F.lit("")) != "") & ((F.col("part") != "entry") | ~F.col("column").isin(LINE_NOTES))
    )
    # only entries are typed; the others meet no column
    typed = columns.where(F.col("fieldtype").isin(EXTRACTABLE_TYPES) & ~F.col("fieldtype").isin(LINK_TYPES)).select(
        F.col("table").alias("_table"), F.col("column").alias("_column"), "fieldtype"
    )
    entry = F.col("part") == "entry"
    same = (F.col("table") == F.col("_table")) & (F.when(entry, F.col("column")) == F.col("_column"))
    value = F.when(entry, coerce_value(F.col("fieldtype"), F.col("text"))).otherwise(F.col("text"))
    cells = (
        given.join(typed, same, "left")
        .where(~entry | F.col("_column").isNotNull())
        .select("doc", "table", "row_no", "column", value.alias("value"), "part")
        .where(F.col("value").isNotNull())
    )
    out = ["doc", "table", "row_no", "column", "value"]
    if columns.where(F.col("column") == "item_name").isEmpty():
        return cells.select(*out)
    cells = written(cells)
    said = cells.where((F.col("part") == "entry") & (F.col("column") == "item_name")).select("doc", "table", "row_no")
    fallback = cells.where(F.col("part") == "fallback").join(said, ["doc", "table", "row_no"], "left_anti")
    return cells.where(F.col("part") != "fallback").select(*out).unionByName(fallback.select(*out))


def apply_line_events(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Lines after review events (doc, row_no, at, kind, value, <columns>).

    ``confirm`` sets the match, ``free_text`` clears it; ``edit`` overwrites
    the columns it gives. The latest event of each sort counts per column.
    """
    edited = ["description", "uom", "qty", "rate", "amount"]
    decision = F.col("kind").isin("confirm", "free_text")
    aggs = [F.max_by(F.struct("kind", "value", "at"), F.when(decision, F.col("at"))).alias("_d")]
    aggs += [
        F.max_by(c, F.when((F.col("kind") == "edit") & F.col(c).isNotNull(), F.col("at"))).alias(f"_{c}") for c in edited
    ]
    # the confidence and method of a confirmation stay when free text follows
    aggs.append(F.max(F.when(F.col("kind") == "confirm", F.lit(True))).alias("_once"))
    latest = events.groupBy("doc", "row_no").agg(*aggs)
    confirmed = F.col("_d.kind") == "confirm"
    decided = F.col("_d").isNotNull()
    replaced = {
        **{c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in edited},
        "matched_item": F.when(confirmed, F.col("_d.value")).when(~decided, F.col("matched_item")),
        "resolution_status": F.when(confirmed, "Confirmed").when(decided, "Free Text").otherwise(F.col("resolution_status")),
        "match_method": F.when(F.col("_once"), "user-confirmed").otherwise(F.col("match_method")),
        "match_confidence": F.when(F.col("_once"), F.lit(1.0)).otherwise(F.col("match_confidence")),
    }
    joined = lines.join(latest, ["doc", "row_no"], "left")
    return joined.select(*[replaced.get(c, F.col(c)).alias(c) for c in lines.columns])


def apply_field_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Header rows after edits (doc, fieldname, at, value, status, user).

    Edits apply one after the other: the last value given counts, and the last
    status. An edit that changes the value makes the field ``Edited`` by someone
    at some time, unless it brings a status of its own.
    """
    earlier = Window.partitionBy("doc", "fieldname").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    known = edits.join(rows.select("doc", "fieldname", F.col("value").alias("_first")), ["doc", "fieldname"])
    before = F.coalesce(F.last("value", ignorenulls=True).over(earlier), F.col("_first"))
    steps = known.withColumn("_changed", F.col("value").isNotNull() & ~F.col("value").eqNullSafe(before)).withColumn(
        "_status", F.coalesce(blank_to_null(F.col("status")), F.when(F.col("_changed"), F.lit("Edited")))
    )
    latest = steps.groupBy("doc", "fieldname").agg(
        F.struct(
            F.expr("max_by(value, at) FILTER (WHERE value IS NOT NULL)").alias("value"),
            F.expr("max_by(_status, at) FILTER (WHERE _status IS NOT NULL)").alias("status"),
            F.expr("max_by(user, at) FILTER (WHERE _changed)").alias("user"),
            F.expr("max(at) FILTER (WHERE _changed)").alias("at"),
        ).alias("_e")
    )
    status = F.coalesce("_e.status", "status")
    rest = [c for c in rows.columns if c not in ("value", "status")]
    return rows.join(latest, ["doc", "fieldname"], "left").select(
        *rest,
        F.coalesce("_e.value", "value").alias("value"),
        status.alias("status"),
        F.col("_e.user").alias("edited_by"),
        F.col("_e.at").alias("edited_on"),
    )


def line_counts(lines: DataFrame) -> DataFrame:
    """(doc, resolved, unresolved): lines with a match or marked as free text."""
    done = F.coalesce(blank_to_null(F.col("matched_item")).isNotNull(), F.lit(False)) | F.coalesce(
        F.col("resolution_status") == "Free Text", F.lit(False)
    )
    return lines.groupBy("doc").agg(F.count_if(done).alias("resolved"), F.count_if(~done).alias("unresolved"))


def provenance(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, part, table, entry, bbox, page): where each field and line was
    printed; the last one of a duplicate counts, entries without a box are left out.

    ``rows``: (doc, pos, fieldname, bbox, source_page); ``lines``: (doc, table,
    row_no, bbox, source_page) with ``pos`` if row numbers repeat.
    """
    fields = rows.where(F.col("bbox").isNotNull()).select(
        "doc",
        F.lit("field").alias("part"),
        F.lit("").alias("table"),
        F.col("fieldname").alias("entry"),
        "bbox",
        F.col("source_page").alias("page"),
        F.coalesce(F.col("pos").cast("bigint"), F.lit(0)).alias("_pos"),
    )
    line_pos = F.col("pos").cast("bigint") if "pos" in lines.columns else F.col("row_no").cast("bigint")
    printed = lines.where(F.col("bbox").isNotNull()).select(
        "doc",
        F.lit("line").alias("part"),
        F.coalesce("table", F.lit("")).alias("table"),
        F.col("row_no").cast("string").alias("entry"),
        "bbox",
        F.col("source_page").alias("page"),
        line_pos.alias("_pos"),
    )
    return keep_last(fields.unionByName(printed), ["doc", "part", "table", "entry"], F.struct("_pos", "bbox", "page")).drop("_pos")
