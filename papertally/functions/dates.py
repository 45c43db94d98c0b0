"""Date expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertally.config import let, literal_map

_NUMERIC = r"\A([0-9]{1,2})[\s\-/.]+([0-9]{1,2})[\s\-/.]+([0-9]{2,4})\z"
_NAMED = r"\A([0-9]{1,2})[\s\-/.]*([A-Za-z]{3,9})[\s\-/.,]*([0-9]{2,4})\z"
_ISO = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})\z"

# Month names by their first three letters.
MONTHS = {
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06",
    "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}


def _calendar_date(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a date that exists; a two-digit year is in this century."""
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(F.lpad(year, 4, "0"))
    # null if a part is null; a text of this form that is no date costs no exception
    iso = F.concat(full, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.when(full != "0000", iso.try_cast("date").cast("string"))


def indian_date(c: Column) -> Column:
    """ISO text of a day-first date, of a date with a month name, or of a date
    that is ISO already; null if it is none of these or does not exist."""
    text = F.trim(c)

    def parts(pattern: str, body: Callable[[Column, Column, Column], Column]) -> Column:
        # the groups in one replacement; none of them holds a blank
        found = F.split(F.regexp_replace(text, pattern, "$1 $2 $3"), " ")
        return let(found, lambda p: body(*[F.get(p, F.lit(i)) for i in range(3)]))

    def named(day: Column, name: Column, year: Column) -> Column:
        return _calendar_date(year, F.element_at(literal_map(MONTHS), F.lower(F.substring(name, 1, 3))), day)

    return (
        F.when(text.rlike(_NUMERIC), parts(_NUMERIC, lambda day, month, year: _calendar_date(year, month, day)))
        .when(text.rlike(_NAMED), parts(_NAMED, named))
        .when(text.rlike(_ISO), parts(_ISO, _calendar_date))
    )


def relative_day(base: Column, offset: Column) -> Column:
    """``base`` moved by an offset such as ``-60d`` or ``+3d``, as text; an
    offset of another shape is returned unchanged."""
    bare = F.trim(F.regexp_replace(F.lower(offset), "[d+]", ""))
    days = F.when(bare.rlike(r"\A-?[0-9]+\z"), bare.try_cast("int"))
    return F.coalesce(F.date_add(base.cast("date"), days).cast("string"), offset)


def within_text_bounds(value: Column, low: Column, high: Column) -> Column:
    """Inclusive range compared as text; a missing value or bound passes."""
    v, lo, hi = (F.coalesce(c.cast("string"), F.lit("")) for c in (value, low, high))
    below = (lo != "") & (v < lo)
    above = (hi != "") & (v > hi)
    return (v == "") | ~(below | above)
