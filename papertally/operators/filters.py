"""Filter specifications compiled to column predicates.

A specification is ``{field: value}``, ``{field: [op, value]}`` or a list of
``[field, op, value]``. ``filters`` are joined by AND, ``or_filters`` by OR, and
the two results by AND.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = re.compile(r"\{([\w.]+)\}")
Condition = tuple[str, str, Any]

_COMPARE = {
    "=": operator.eq, "==": operator.eq, "!=": operator.ne, "<>": operator.ne,
    "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
}


def conditions(spec: Mapping | Sequence | None) -> list[Condition]:
    """Any accepted form as a list of (field, operator, value)."""
    if isinstance(spec, Mapping):
        out = []
        for field, value in spec.items():
            paired = isinstance(value, list | tuple) and len(value) == 2
            out.append((field, value[0], value[1]) if paired else (field, "=", value))
        return out
    usable = [c for c in spec or [] if isinstance(c, list | tuple) and len(c) == 3]
    return [(field, op, value) for field, op, value in usable]


class DocumentValues:
    """The extracted values of one document, for plan-time substitution."""

    def __init__(self, fields: Mapping[str, Any] | None = None, context: Mapping[str, Any] | None = None):
        self.fields = dict(fields or {})
        self.context = dict(context or {})

    def values(self, key: str) -> list[Any]:
        entry = self.fields.get(key)
        items = entry if isinstance(entry, list) else [entry]
        return list(dict.fromkeys(v for v in items if v not in (None, "")))

    def is_list(self, key: str) -> bool:
        return isinstance(self.fields.get(key), list)

    def text(self, reference: str) -> str:
        """First value of a key, or of a ``context.`` entry; '' when missing."""
        if reference.startswith("context."):
            found = self.context.get(reference.removeprefix("context."), "")
        else:
            entry = self.fields.get(reference)
            found = (entry[0] if entry else None) if isinstance(entry, list) else entry
        return "" if found is None else str(found)

    def fill(self, value: Any) -> Any:
        if not isinstance(value, str):
            return value
        return PLACEHOLDER.sub(lambda hit: self.text(hit.group(1)), value)


def resolve(spec: Mapping | Sequence | None, doc: DocumentValues) -> list[Condition]:
    """Substitute placeholders and drop every condition left without a value."""
    resolved: list[Condition] = []
    for field, op, value in conditions(spec):
        resolved.extend(_resolve_one(field, str(op).lower(), value, doc))
    return resolved


def _resolve_one(field: str, op: str, value: Any, doc: DocumentValues) -> list[Condition]:
    if isinstance(value, str):
        keys = [k for k in PLACEHOLDER.findall(value) if not k.startswith("context.")]
        if op in ("in", "not in") and keys and value == "{" + keys[0] + "}":
            found = doc.values(keys[0])
            return [(field, op, found)] if found else []
        listed = [k for k in keys if doc.is_list(k)]
        if op in ("like", "not like") and listed:
            patterns = [doc.fill(value.replace("{" + listed[0] + "}", str(v))) for v in doc.values(listed[0])]
            return [(field, op, p) for p in patterns if p]
        value = doc.fill(value)
        if op in ("like", "not like") and not value.strip("%_ "):
            return []
    return [] if value in (None, "") else [(field, op, value)]


def to_column(condition: Condition) -> Column:
    field, op, value = condition
    op, c = str(op).lower(), F.col(field)
    if op in _COMPARE:
        return _COMPARE[op](c, F.lit(value))
    if op in ("in", "not in"):
        hit = c.isin(list(value) if isinstance(value, list | tuple | set) else [value])
        return hit if op == "in" else ~hit
    if op in ("like", "not like"):
        return c.like(str(value)) if op == "like" else ~c.like(str(value))
    if op == "between":
        low, high = value
        return c.between(F.lit(low), F.lit(high))
    return c == F.lit(value)


def predicate(all_of: Sequence[Condition], any_of: Sequence[Condition]) -> Column | None:
    parts = [to_column(c) for c in all_of]
    if any_of:
        parts.append(functools.reduce(operator.or_, [to_column(c) for c in any_of]))
    return functools.reduce(operator.and_, parts) if parts else None


def table_scan(
    table: DataFrame,
    filters: Mapping | Sequence | None = None,
    or_filters: Mapping | Sequence | None = None,
    fields: Sequence[str] | str = "*",
    order_by: Sequence[Column] | None = None,
    limit: int | None = None,
    doc: DocumentValues | None = None,
    key: str = "name",
    guard: bool = False,
    allow_unfiltered: bool = False,
) -> DataFrame:
    """Scan with a filter specification; ``key`` always leads the column list.

    With ``guard`` a scan whose conditions were all dropped returns no row
    instead of the whole table, unless ``allow_unfiltered`` is set; declared
    ``or_filters`` that all dropped return no row in any case.
    """
    values = doc or DocumentValues()
    all_of, any_of = resolve(filters, values), resolve(or_filters, values)
    unbounded = bool(or_filters) and not any_of
    unbounded = unbounded or not (all_of or any_of or allow_unfiltered)
    condition = F.lit(False) if guard and unbounded else predicate(all_of, any_of)
    out = table if condition is None else table.where(condition)
    if fields != "*":
        out = out.select(*dict.fromkeys([key, *fields]))
    if order_by:
        out = out.orderBy(*order_by)
    return out if limit is None else out.limit(limit)


def type_ahead(
    table: DataFrame,
    text: str,
    search_field: str,
    key: str = "name",
    filters: Mapping[str, Any] | None = None,
    order_by: str = "modified desc",
    start: int = 0,
    page_len: int = 20,
    tie_break: str | None = None,
) -> DataFrame:
    """One page of keys whose field holds the typed text.

    ``order_by`` is a field, ascending unless followed by ``desc``; ``tie_break``
    makes the page repeatable when that field has equal values.
    """
    field, _, direction = order_by.partition(" ")
    field = field if field in table.columns else key
    order = [F.col(field).desc() if direction.strip().lower() == "desc" else F.col(field).asc()]
    if tie_break:
        order.append(F.col(tie_break))
    out = table
    if text:
        out = out.where(F.col(search_field).like(f"%{text}%"))
    for name, value in (filters or {}).items():
        out = out.where(F.col(name) == F.lit(value))
    return out.orderBy(*order).offset(start).limit(page_len).select(key)


def preview_with_total(table: DataFrame, order_by: Sequence[Column], limit: int = 10) -> DataFrame:
    """First rows, each carrying the full row count (a scalar subquery)."""
    total = table.agg(F.count(F.lit(1)).alias("total_count")).scalar()
    return table.orderBy(*order_by).limit(limit).select("*", total.alias("total_count"))


def newest_first(table: DataFrame, filters: Mapping[str, Any], order_field: str = "creation") -> DataFrame:
    return table_scan(table, filters, order_by=[F.col(order_field).desc()])


def show_fields(table: DataFrame, wanted: str | None, list_view: Sequence[str], key: str = "name") -> DataFrame:
    """Columns from a comma list, else the list-view ones; unknown ones are dropped."""
    names = [f.strip() for f in wanted.split(",") if f.strip()] if wanted else list(list_view)
    if key not in names:
        names.insert(0, key)
    return table.select(*[n for n in names if n in table.columns])


def list_view_columns(fields: Sequence[Mapping[str, Any]], title_field: str | None, key: str = "name") -> list[str]:
    """Column names of a list view: title, flagged fields, key, ``modified``."""
    names = dict.fromkeys([title_field] if title_field else [])
    names.update(dict.fromkeys(f["fieldname"] for f in fields if f.get("in_list_view")))
    ordered = list(names)
    if key not in names:
        ordered.insert(0, key)
    return ordered if "modified" in ordered else [*ordered, "modified"]


def distinct_targets(table: DataFrame, column: str, enabled: Column | None = None) -> DataFrame:
    """Distinct non-empty values, optionally of enabled rows only."""
    rows = table if enabled is None else table.where(enabled)
    return rows.where(F.col(column) != "").select(column).distinct()
