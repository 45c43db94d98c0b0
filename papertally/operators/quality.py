"""Checks on extracted items, repairs, and the gate.

``items``   (doc, key, idx, value, raw_text, confidence, bbox[, cross_check]):
            one row per item, ``idx`` null for a single-valued key. A key of
            list kind without items has no row.
``schema``  a list of :class:`FieldSpec`.

Deficiencies are rows (doc, key, idx, kind, detail).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertally.config import config_frame, literal_array, literal_map
from papertally.functions.boxes import area, iou
from papertally.functions.formats import normalize_by_key
from papertally.functions.numbers import try_int
from papertally.functions.text import blank_to_null

# Thresholds of the checks.
COLLISION_IOU = 0.85
MAX_BOX_AREA = 0.35
REJECTED_IOU = 0.6

# Kinds of deficiencies in the order of the checks.
KIND_ORDER = [
    "format",
    "missing_value",
    "bbox_missing",
    "bbox_insane",
    "bbox_collision",
    "cross_check_miss",
    "value_disagreement",
]


@dataclass(frozen=True)
class FieldSpec:
    """One entry of an output schema."""

    key: str
    kind: str = "scalar"
    required: bool = False
    format: str | None = None
    bbox_required: bool = False
    label: str | None = None
    is_title: bool = False


def schema_frame(spark, schema: Sequence[FieldSpec]) -> DataFrame:
    rows = [
        (s.key, i, s.kind == "array", s.required, s.format, s.bbox_required, s.is_title)
        for i, s in enumerate(schema)
    ]
    return config_frame(
        spark,
        rows,
        "key string, key_ord int, is_list boolean, required boolean, format string, "
        "bbox_required boolean, is_title boolean",
    )


def filled(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _keys(schema: Sequence[FieldSpec], test) -> list[str]:
    return [s.key for s in schema if test(s)]


def _order(schema: Sequence[FieldSpec]) -> Column:
    return F.element_at(literal_map({s.key: i for i, s in enumerate(schema)}), F.col("key"))


def apply_formats(items: DataFrame, schema: Sequence[FieldSpec]) -> DataFrame:
    """Items with normalised values and ``format_ok``; a value that fails its
    format is stored in its cleaned form all the same."""
    shaped = normalize_by_key(F.col("key"), F.col("value"), F.col("raw_text"), {s.key: s.format for s in schema})
    rest = [c for c in items.columns if c != "value"]
    return items.withColumn("_n", shaped).select(
        *rest, F.col("_n.value").alias("value"), F.coalesce("_n.ok", F.lit(False)).alias("format_ok")
    )


def _deficiency(rows: DataFrame, kind: str, detail: Column, idx: str | None = "idx") -> DataFrame:
    index = F.col(idx) if idx else F.lit(None)
    return rows.select("doc", "key", index.cast("int").alias("idx"), F.lit(kind).alias("kind"), detail.alias("detail"))


def item_deficiencies(items: DataFrame, schema: Sequence[FieldSpec]) -> DataFrame:
    """The checks that look at one item (``format``, ``bbox_missing``,
    ``bbox_insane``) in a single pass over the items."""
    fmt_of = literal_map({s.key: s.format or "" for s in schema})
    boxed = F.col("key").isin(_keys(schema, lambda s: s.bbox_required))
    shown = F.concat(F.lit("'"), F.col("value"), F.lit("'"))
    percent = F.round(area(F.col("bbox")) * 100).cast("int").cast("string")

    def found(kind: str, test: Column, detail: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))

    checks = [
        found(
            "format",
            ~F.col("format_ok"),
            F.concat(F.lit("value "), shown, F.lit(" fails format "), F.element_at(fmt_of, F.col("key"))),
        ),
        found(
            "bbox_missing",
            boxed & filled(F.col("value")) & F.col("bbox").isNull(),
            F.lit("value present without a bounding box"),
        ),
        found(
            "bbox_insane",
            area(F.col("bbox")) > MAX_BOX_AREA,
            F.concat(F.lit("bbox covers "), percent, F.lit("% of the page — not a tight value box")),
        ),
    ]
    return items.select("doc", "key", F.col("idx").cast("int").alias("idx"), F.inline(F.array_compact(F.array(*checks))))


# Keys whose marks one number holds.
_MARKS = 62


def _lacking(docs: DataFrame, items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of ``docs`` and ``key``: each of these keys a document has no item of.

    A document's keys are bits of a number (of several for a long schema): an
    aggregate of fixed width, made in place, where sets would be sorted.
    """
    parts = [keys[i : i + _MARKS] for i in range(0, len(keys), _MARKS)]
    if not parts:
        return docs.where(F.lit(False)).withColumn("key", F.lit(""))

    def mark(part: Sequence[str]) -> Column:
        return F.coalesce(F.element_at(literal_map({k: 1 << i for i, k in enumerate(part)}), F.col("key")).cast("bigint"), F.lit(0))

    marks = [F.bit_or(mark(part)).alias(f"_m{i}") for i, part in enumerate(parts)]
    have = items.where(F.col("key").isin(list(keys))).groupBy("doc").agg(*marks)
    absent = [
        F.when(F.coalesce(F.col(f"_m{i}"), F.lit(0)).bitwiseAND(F.lit(1 << j)) == 0, F.lit(k))
        for i, part in enumerate(parts)
        for j, k in enumerate(part)
    ]
    wide = docs.join(have, "doc", "left").select(*docs.columns, F.explode(F.array(*absent)).alias("key"))
    return wide.where(F.col("key").isNotNull())


def missing_required(items: DataFrame, docs: DataFrame, schema: Sequence[FieldSpec]) -> DataFrame:
    """``missing_value`` per document and required key without a filled item.

    The missing ones follow from one join; see :func:`_lacking`.
    """
    required = _keys(schema, lambda s: s.required)
    rows = _lacking(docs.select("doc").distinct(), items.where(filled(F.col("value"))), required)
    return _deficiency(rows, "missing_value", F.lit("required field absent"), None)


def _level(side: Column) -> Column:
    """Level L holds sides from 4^L up to 4^(L+1); its cells are 4^(L+1) wide."""
    return F.floor(F.log2(side) / 2).cast("int")


def _cell(edge: Column, level: Column, shift: float = 0.0) -> Column:
    return F.floor(edge / F.pow(F.lit(4.0), level.cast("double") + 1) + shift)


def _places(edge: Column, side: Column) -> Column:
    """Places along one axis where a nearly equal box can lie: four
    ``struct<level, cell>``, those that repeat another one null.

    Two boxes with an IoU of at least 0.85 have sides within a factor of 0.85,
    which is two levels at most. Their left edges are furthest apart when one lies
    right-aligned in the other: by 1/0.85 - 1 = 0.1765 of the smaller side, and a
    side is less than a cell, so that is two cells of a level at most.
    """
    slack = COLLISION_IOU * 0.999
    reach = 0.18
    low, high = _level(side * slack), _level(side / slack)

    def place(level: Column, shift: float) -> Column:
        return F.struct(level.alias("level"), _cell(edge, level, shift).alias("cell"))

    def beside(level: Column) -> Column:
        return _cell(edge, level, -reach) != _cell(edge, level, reach)

    return F.array(
        place(low, -reach),
        F.when(beside(low), place(low, reach)),
        F.when(low != high, place(high, -reach)),
        F.when((low != high) & beside(high), place(high, reach)),
    )


def colliding_pairs(items: DataFrame, schema: Sequence[FieldSpec]) -> DataFrame:
    """Pairs of boxes of one document, of different keys, that nearly coincide:
    (doc, key, idx, other_key, other_idx), the earlier one first.

    Boxes meet in a grid (see :func:`_places`), not all against all: each lies in
    one place and looks for partners in a few.
    """
    boxes = items.where((F.col("bbox.w") > 0) & (F.col("bbox.h") > 0)).select(
        "doc", "key", "idx", "bbox", F.struct(_order(schema).alias("k"), F.coalesce("idx", F.lit(-1)).alias("i")).alias("ord")
    )
    at = ["lx", "cx", "ly", "cy"]

    def own(axis: str, side: str) -> list[Column]:
        level = _level(F.col(f"bbox.{side}"))
        return [level.alias(f"l{axis}"), _cell(F.col(f"bbox.{axis}"), level).alias(f"c{axis}")]

    left = boxes.select(
        "doc", *own("x", "w"), *own("y", "h"),
        F.col("key").alias("a_key"), F.col("idx").alias("a_idx"),
        F.col("bbox").alias("a_box"), F.col("ord").alias("a_ord"),
    )
    wide = boxes.withColumn("px", F.explode(_places(F.col("bbox.x"), F.col("bbox.w")))).where(F.col("px").isNotNull())
    wide = wide.withColumn("py", F.explode(_places(F.col("bbox.y"), F.col("bbox.h")))).where(F.col("py").isNotNull())
    right = wide.select(
        "doc", F.col("px.level").alias("lx"), F.col("px.cell").alias("cx"), F.col("py.level").alias("ly"), F.col("py.cell").alias("cy"),
        F.col("key").alias("b_key"), F.col("idx").alias("b_idx"),
        F.col("bbox").alias("b_box"), F.col("ord").alias("b_ord"),
    )
    met = left.join(right, ["doc", *at]).where(
        (F.col("a_ord") < F.col("b_ord"))
        & (F.col("a_key") != F.col("b_key"))
        & (iou(F.col("a_box"), F.col("b_box")) >= COLLISION_IOU)
    )
    return met.select(
        "doc",
        F.col("a_key").alias("key"),
        F.col("a_idx").alias("idx"),
        F.col("b_key").alias("other_key"),
        F.col("b_idx").alias("other_idx"),
    )


def box_collisions(items: DataFrame, schema: Sequence[FieldSpec]) -> DataFrame:
    other = F.concat(
        F.col("other_key"), F.lit("["), F.coalesce(F.col("other_idx").cast("string"), F.lit("None")), F.lit("]")
    )
    detail = F.concat(F.lit("bbox overlaps field "), other, F.lit(f" (IoU >= {COLLISION_IOU})"))
    return _deficiency(colliding_pairs(items, schema), "bbox_collision", detail)


def cross_check(
    items: DataFrame,
    target: DataFrame,
    key: str,
    field: str,
    doctype: str,
    context: DataFrame | None = None,
    context_fields: dict[str, str] | None = None,
) -> DataFrame:
    """Items with ``cross_check`` set to ``matched`` or ``miss`` for one key.

    ``context`` (doc, <columns>) with ``context_fields`` {target column:
    context column} adds equalities; one left empty is no condition, so each
    set of given values is looked up by itself. Duplicates in the target do not
    multiply items.
    """
    own = items.where((F.col("key") == key) & filled(F.col("value")))
    pairs = dict(context_fields or {})
    known = target.select(
        F.col(field).cast("string").alias("value"), *[F.col(t).cast("string").alias(f"_{t}") for t in pairs]
    )
    if pairs and context is not None:
        own = own.join(context.select("doc", *[F.col(c).cast("string").alias(f"_c_{t}") for t, c in pairs.items()]), "doc", "left")
        # distinct value combinations decide; an empty context value passes
        asked = own.select("value", *[f"_c_{t}" for t in pairs]).distinct()
        test = asked["value"] == known["value"]
        for t in pairs:
            test = test & (~filled(asked[f"_c_{t}"]) | (asked[f"_c_{t}"] == known[f"_{t}"]))
        found = asked.join(known, test, "left_semi").withColumn("_found", F.lit(True))
        same = [own["value"] == found["value"]]
        same += [own[f"_c_{t}"].eqNullSafe(found[f"_c_{t}"]) for t in pairs]
        joined = own.join(found, same, "left").select(own["*"], found["_found"])
    else:
        found = known.select("value").distinct().withColumn("_found", F.lit(True))
        joined = own.join(found, "value", "left")
    status = F.when(F.col("_found"), "matched").otherwise("miss")
    return joined.select("doc", "key", "idx", "value", status.alias("cross_check"), F.lit(doctype).alias("doctype"), F.lit(field).alias("field"))


def cross_check_misses(checked: DataFrame) -> DataFrame:
    shown = F.concat(F.lit("'"), F.col("value"), F.lit("'"))
    detail = F.concat(
        F.lit("no "), "doctype", F.lit(" found with "), "field", F.lit(" = "), shown,
        F.lit(" — re-read the value from the image"),
    )
    return _deficiency(checked.where(F.col("cross_check") == "miss"), "cross_check_miss", detail)


def usable_index(rows: DataFrame, schema: Sequence[FieldSpec], items: DataFrame | None = None) -> DataFrame:
    """Keep rows of known keys with a usable ``idx``.

    ``rows``: (doc, key, idx as text, ...). A single-valued key always gets a
    null index; a list index must be a whole number, and with ``items`` it must
    lie inside the list.
    """
    known = [s.key for s in schema]
    lists = _keys(schema, lambda s: s.kind == "array")
    is_list = F.col("key").isin(lists)
    asked = F.coalesce(F.nullif(F.trim(F.col("idx").cast("string")), F.lit("")), F.lit("0"))
    number = try_int(asked)
    kept = rows.where(F.col("key").isin(known)).withColumn("_i", F.when(is_list, number))
    kept = kept.where(~is_list | F.col("_i").isNotNull())
    if items is not None:
        sizes = items.where(F.col("key").isin(lists)).groupBy("doc", "key").agg(F.count(F.lit(1)).alias("_len"))
        kept = kept.join(sizes, ["doc", "key"], "left").where(
            ~is_list | ((F.col("_i") >= 0) & (F.col("_i") < F.coalesce("_len", F.lit(0))))
        )
    rest = [c for c in rows.columns if c != "idx"]
    return kept.select(*rest, F.col("_i").cast("int").alias("idx"))


def disagreements(rows: DataFrame, schema: Sequence[FieldSpec], items: DataFrame) -> DataFrame:
    """Verifier rows (doc, key, idx, expected, reason) as deficiencies."""
    detail = F.concat(
        F.lit("verifier: image shows '"), F.coalesce("expected", F.lit("")), F.lit("' ("),
        F.coalesce("reason", F.lit("")), F.lit(")"),
    )
    return _deficiency(usable_index(rows, schema, items), "value_disagreement", detail)


def gate(
    items: DataFrame,
    deficiencies: DataFrame,
    schema: Sequence[FieldSpec],
    docs: DataFrame,
    automated: Column,
) -> DataFrame:
    """(doc, key, idx, status, reason): the verdict on every item.

    ``automated`` is a column of ``docs``. Each document also gets a row for a
    single-valued key without an item, and one for a list that is missing but
    has a deficiency of its own. Reasons list the kinds of deficiencies in the
    order of the checks; kinds are few, however many deficiencies there are.
    """
    lists = _keys(schema, lambda s: s.kind == "array")
    scalars = _keys(schema, lambda s: s.kind != "array")
    bad = deficiencies.groupBy("doc", "key", "idx", "kind").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(literal_array(KIND_ORDER), F.col("kind")).alias("place")
    kinds = F.array_sort(F.collect_list(F.struct(place, "kind", "n")))
    per_item = bad.groupBy("doc", "key", F.coalesce("idx", F.lit(-1)).alias("_idx")).agg(_kind_list(kinds).alias("_kinds"))
    whole = per_item.where((F.col("_idx") == -1) & F.col("key").isin(lists)).select(
        "doc", "key", F.col("_kinds").alias("_whole")
    )
    mode = docs.select("doc", automated.alias("_auto")).distinct()

    empty = _lacking(mode, items, scalars).select(
        "doc", "key", F.lit(None).cast("int").alias("idx"), F.lit("Pending").alias("status"), F.lit("no value").alias("reason")
    )
    hollow_lists = whole.join(items.select("doc", "key").distinct(), ["doc", "key"], "left_anti").select(
        "doc",
        "key",
        F.lit(None).cast("int").alias("idx"),
        F.lit("Pending").alias("status"),
        F.col("_whole").alias("reason"),
    )
    checked = F.col("cross_check") if "cross_check" in items.columns else F.lit(None).cast("string")
    whole_kinds = F.when(F.col("idx").isNotNull(), F.col("_whole"))
    troubles = F.concat_ws(",", blank_to_null(F.col("_kinds")), blank_to_null(whole_kinds))
    clean = F.col("_kinds").isNull() & whole_kinds.isNull()
    auto = F.coalesce("_auto", F.lit(False))
    status = F.when(auto & clean, "Approved").otherwise("Pending")
    reason = (
        F.when(~clean, troubles)
        .when(~auto, "manual mode")
        .when(F.coalesce(F.col("_check") == "matched", F.lit(False)), "ground-truth cross-check")
        .otherwise("all checks passed")
    )
    judged = (
        items.withColumn("_idx", F.coalesce("idx", F.lit(-1)))
        .withColumn("_check", checked)
        .join(per_item, ["doc", "key", "_idx"], "left")
        .join(whole, ["doc", "key"], "left")
        .join(mode, "doc", "left")
        .select("doc", "key", F.col("idx").cast("int").alias("idx"), status.alias("status"), reason.alias("reason"))
    )
    return judged.unionByName(empty).unionByName(hollow_lists)


def _kind_list(kinds: Column) -> Column:
    """``format,format,bbox_missing``: a kind as often as it occurred."""
    return F.array_join(
        F.flatten(F.transform(kinds, lambda k: F.array_repeat(k["kind"], k["n"].cast("int")))), ","
    )


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """(doc, key, n_approved, n_pending, statuses): statuses per key, counted and
    listed in the order of the items."""
    placed = F.struct(F.coalesce("idx", F.lit(-1)).alias("idx"), "status")
    return verdicts.groupBy("doc", "key").agg(
        F.count_if(F.col("status") == "Approved").alias("n_approved"),
        F.count_if(F.col("status") == "Pending").alias("n_pending"),
        F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["status"]).alias("statuses"),
    )


# Match states that send a document to a human.
OPEN_MATCH_STATES = ["doubt", "none", "error", "conflict"]


def document_status(
    docs: DataFrame,
    deficiencies: DataFrame,
    match_states: DataFrame | None = None,
    resolution: DataFrame | None = None,
) -> DataFrame:
    """(doc, status): ``Completed`` unless a deficiency, the match or the
    resolution is open."""
    out = docs.select("doc").distinct()
    out = out.join(deficiencies.groupBy("doc").agg(F.count(F.lit(1)).alias("_bad")), "doc", "left")
    open_ = F.coalesce("_bad", F.lit(0)) > 0
    if match_states is not None:
        out = out.join(match_states.select("doc", F.col("status").alias("_match")), "doc", "left")
        open_ = open_ | F.coalesce(F.col("_match").isin(OPEN_MATCH_STATES), F.lit(False))
    if resolution is not None:
        out = out.join(resolution.select("doc", "resolved"), "doc", "left")
        open_ = open_ | ~F.coalesce("resolved", F.lit(True))
    return out.select("doc", F.when(open_, "Needs Review").otherwise("Completed").alias("status"))


def rejected_boxes(outcomes: DataFrame) -> DataFrame:
    """(doc, key, idx, bbox): boxes whose crop a check (doc, key, idx, bbox,
    contains) did not confirm, be it by a no or without an answer."""
    kept = outcomes.where(F.col("bbox").isNotNull() & ~F.coalesce("contains", F.lit(False)))
    return kept.select("doc", "key", "idx", "bbox").distinct()


def patch_merge(
    items: DataFrame,
    repairs: DataFrame,
    asked: DataFrame,
    schema: Sequence[FieldSpec],
    rejected: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Merge repairs (doc, pos, key, idx, value, raw_text, confidence, bbox).

    Only asked (doc, key, idx) pairs, or (doc, key, null) for a whole key, may
    change; the others are returned as dropped. Per item the later repair wins
    field by field. An item that was missing is created when a value comes; a
    null value keeps the old one. Repairs of a missing item count from the first
    that brings a value. A new box that covers too much of the page or was
    rejected before (``rejected``: doc, key, idx, bbox; see
    :func:`rejected_boxes`) leaves the box as the repairs before it made it; the
    cross-check mark of a repaired item is cleared. ``pos`` is unique in a document.
    """
    lists = _keys(schema, lambda s: s.kind == "array")
    usable = usable_index(repairs, schema)
    requested = asked.select("doc", "key", F.coalesce("idx", F.lit(-1)).alias("_i")).distinct()
    one = requested.withColumn("_one", F.lit(True))
    any_ = requested.where(F.col("_i") == -1).select("doc", "key").withColumn("_any", F.lit(True))
    tagged = (
        usable.withColumn("_i", F.coalesce("idx", F.lit(-1)))
        .join(one, ["doc", "key", "_i"], "left")
        .join(any_, ["doc", "key"], "left")
    )
    permitted = F.col("_one").isNotNull() | F.col("_any").isNotNull()
    dropped = tagged.where(~permitted).select("doc", "key", "idx", F.lit("not among the asked deficiencies").alias("note"))
    given = F.col("value").isNotNull()
    # an index past the end of a list falls on its first item
    sizes = items.where(F.col("key").isin(lists)).groupBy("doc", "key").agg(F.count(F.lit(1)).alias("_len"))
    inside = F.coalesce((F.col("_i") >= 0) & (F.col("_i") < F.col("_len")), F.lit(False))
    place = F.when(~F.col("key").isin(lists) | inside, F.col("_i")).otherwise(F.lit(0))
    present = items.select("doc", "key", F.coalesce("idx", F.lit(-1)).alias("_i")).distinct().withColumn("_have", F.lit(True))
    item = ["doc", "key", "_i"]
    begun = F.min(F.when(filled(F.col("value")), F.col("pos"))).over(Window.partitionBy(*item))
    counted = (
        tagged.where(permitted)
        .join(sizes, ["doc", "key"], "left")
        .withColumn("_i", place)
        .join(present, item, "left")
        .withColumn("_begun", begun)
        .where(F.col("_have") | (F.col("pos") >= F.col("_begun")))
    )
    boxes = counted.where(area(F.col("bbox")) <= MAX_BOX_AREA).select(*item, "pos", "bbox")
    if rejected is not None:
        bad = rejected.select(
            F.col("doc").alias("_rd"), F.col("key").alias("_rk"), F.coalesce("idx", F.lit(-1)).alias("_ri"), F.col("bbox").alias("_rb")
        )
        same = (F.col("doc") == F.col("_rd")) & (F.col("key") == F.col("_rk")) & (F.col("_i") == F.col("_ri"))
        boxes = boxes.join(bad, same & (iou(F.col("bbox"), F.col("_rb")) > REJECTED_IOU), "left_anti")
    fit = boxes.groupBy(*item).agg(F.max_by("bbox", "pos").alias("_box"))
    latest = (
        counted.groupBy(*item)
        .agg(
            F.max_by(F.when(given, F.struct("value", "raw_text")), F.when(given, F.col("pos"))).alias("_new"),
            F.max_by("confidence", F.when(F.col("confidence").isNotNull(), F.col("pos"))).alias("_conf"),
        )
        .join(fit, item, "left")
    )

    old = items.withColumn("_i", F.coalesce("idx", F.lit(-1)))
    joined = old.withColumn("_old", F.lit(True)).join(latest.withColumn("_fix", F.lit(True)), ["doc", "key", "_i"], "full")
    joined = joined.where(F.col("_old") | filled(F.col("_new.value")))
    created = F.col("_old").isNull()
    index = F.when(F.col("key").isin(lists), F.when(created, F.lit(0)).otherwise(F.col("_i"))).cast("int")
    text = F.when(
        F.col("_new").isNotNull(), F.coalesce(F.nullif(F.col("_new.raw_text"), F.lit("")), F.col("_new.value"))
    ).otherwise(F.col("raw_text"))
    merged = joined.select(
        "doc",
        "key",
        index.alias("idx"),
        F.coalesce("_new.value", "value").alias("value"),
        text.alias("raw_text"),
        F.coalesce("_conf", "confidence").alias("confidence"),
        F.coalesce("_box", "bbox").alias("bbox"),
        F.coalesce("_fix", F.lit(False)).alias("repaired"),
        *(
            [F.when(F.col("_fix").isNull(), F.col("cross_check")).alias("cross_check")]
            if "cross_check" in items.columns
            else []
        ),
    )
    return merged, dropped


def schema_errors(actions: DataFrame) -> DataFrame:
    """(action, pos, error): entries of an ``output_schema`` that are no object
    with a key, and schemas that are no JSON list."""
    parsed = F.try_parse_json(F.nullif(F.trim("output_schema"), F.lit("")))
    listed = F.try_variant_get(parsed, "$", "array<variant>")
    given = actions.where(F.coalesce(F.trim("output_schema"), F.lit("")) != "")
    shapes = given.select("action", parsed.alias("_p"), listed.alias("_l"))
    broken = shapes.where(F.col("_p").isNull() | F.col("_l").isNull()).select(
        "action",
        F.lit(None).cast("int").alias("pos"),
        F.when(F.col("_p").isNull(), "not valid JSON").otherwise("not a list").alias("error"),
    )
    entries = shapes.where(F.col("_l").isNotNull()).select("action", F.posexplode("_l").alias("pos", "_e"))
    keyless = entries.where(F.coalesce(F.try_variant_get("_e", "$.key", "string"), F.lit("")) == "").select(
        "action", "pos", F.lit('entry without a "key"').alias("error")
    )
    return broken.unionByName(keyless)
