"""Text expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertally.config import literal_map

# Labels of the standard fields when a table defines none.
STANDARD_FIELD_LABELS = {
    "creation": "Created On",
    "modified": "Last Updated On",
    "name": "ID",
}


def blank_to_null(c: Column) -> Column:
    """Empty text means "no value" everywhere in this package."""
    return F.nullif(c, F.lit(""))


def text_key(c: Column) -> Column:
    """Key of a printed text: lower case, runs of white space made one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[\s\x1c-\x1f]+", " "))


def match_key(c: Column) -> Column:
    """Key for locating a value among words: only a-z and 0-9 remain."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def alnum_key(c: Column) -> Column:
    """Upper-cased ASCII letters and digits."""
    return F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))


def strip_spaces(value: Column, raw_text: Column) -> Column:
    """Remove white space, preferring the printed text if it carries the same
    letters and digits (so a printed hyphen survives)."""
    same = (F.coalesce(raw_text, F.lit("")) != "") & (alnum_key(raw_text) == alnum_key(value))
    source = F.when(same, raw_text).otherwise(value)
    return F.regexp_replace(source, r"(?U)[\s\x1c-\x1f]+", "")


def trailing_digits(c: Column) -> Column:
    """Number at the end of a text as canonical digits, null if there is none.

    ``INV-01422`` and ``1422`` both give ``1422``. Staying text avoids integer
    overflow, and equality of the result is equality of the numbers, so suffix
    matching is an equi-join.
    """
    digits = F.regexp_extract(c, "([0-9]+)$", 1)
    return blank_to_null(F.regexp_replace(digits, "^0+(?=[0-9])", ""))


def slug(c: Column) -> Column:
    """URL slug of at most 140 characters; the cut comes last."""
    dashed = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 140)


def user_list(c: Column) -> Column:
    """Users from a JSON list, or from text separated by commas or new lines."""
    text = F.trim(c)
    parsed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    split = F.split(text, "[,\n]")
    names = F.transform(F.coalesce(parsed, split), lambda u: F.regexp_replace(u, r"^\s+|\s+$", ""))
    kept = F.array_distinct(F.filter(names, lambda u: u.isNotNull() & (u != "")))
    return F.coalesce(kept, F.array().cast("array<string>"))


def looks_truncated(c: Column) -> Column:
    """More opening than closing braces."""
    return F.coalesce(
        F.regexp_count(c, F.lit(r"\{")) > F.regexp_count(c, F.lit(r"\}")), F.lit(False)
    )


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def field_label(fieldname: Column, configured: Column, meta_label: Column) -> Column:
    """Configured label, else the table's own, else a standard one, else the
    field name in title case."""
    standard = F.element_at(literal_map(STANDARD_FIELD_LABELS), fieldname)
    return F.coalesce(
        blank_to_null(F.trim(configured)),
        blank_to_null(meta_label),
        standard,
        title_case(fieldname),
    )


_MERGE_FIELD = re.compile(r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}")


def render_template(template: str, values: Mapping[str, Column]) -> Column:
    """Compile ``Hello {{ name }}`` to one concatenation; unknown or null
    fields render as nothing."""
    parts: list[Column] = []
    at = 0
    for hit in _MERGE_FIELD.finditer(template):
        if hit.start() > at:
            parts.append(F.lit(template[at : hit.start()]))
        value = values.get(hit.group(1))
        if value is not None:
            parts.append(F.coalesce(value.cast("string"), F.lit("")))
        at = hit.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def value_variants(raw_text: Column, value: Column) -> Column:
    """Printed forms to look for: the printed text, the value, and a whole
    decimal such as ``554.0`` also without its fraction."""
    whole = F.when(value.rlike(r"\A-?[0-9]+\.0+\z"), F.regexp_replace(value, r"\.0+$", ""))
    forms = F.array(blank_to_null(raw_text), blank_to_null(value), whole)
    return F.array_distinct(F.array_compact(forms))


def content_hash(c: Column) -> Column:
    return F.sha1(F.coalesce(c, F.lit("")))


def log_namespace(filename: Column) -> Column:
    """Text before the first ``.log``; null if the name holds none."""
    return F.when(filename.contains(".log"), F.substring_index(filename, ".log", 1))
