"""Field formats: normalise a value and say whether it fits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertally.config import let
from papertally.functions.dates import indian_date
from papertally.functions.numbers import is_finite, try_double
from papertally.functions.text import strip_spaces


def _result(value: Column, ok: Column) -> Column:
    return F.struct(value.alias("value"), ok.alias("ok"))


def amount_text(number: Column) -> Column:
    """Text of an amount with one or two decimals (``1554.0``, ``12.25``); from
    1e36 on, where decimals end, with an exponent (``1.0E36``)."""
    plain = F.regexp_replace(number.try_cast("decimal(38,2)").cast("string"), "0$", "")
    return F.when(F.abs(number) < 1e36, plain).otherwise(number.cast("string"))


def normalize(value: Column, raw_text: Column, fmt: str | None) -> Column:
    """``struct(value, ok)`` for one format; an empty value is always fine."""
    text = F.trim(value)
    yes = F.lit(True)
    if not fmt:
        shaped = _result(text, yes)
    elif fmt == "strip-spaces":
        shaped = _result(strip_spaces(text, raw_text), yes)
    elif fmt.startswith("digits:"):
        digits = F.regexp_replace(text, "[^0-9]", "")
        shaped = _result(digits, F.length(digits) == int(fmt.split(":", 1)[1]))
    elif fmt == "amount":
        number = try_double(F.regexp_replace(text, r"[^0-9.\-]", ""))

        def rounded(n: Column) -> Column:
            good = F.coalesce(is_finite(n), F.lit(False))
            return _result(F.when(good, amount_text(F.round(n, 2))).otherwise(text), good)

        shaped = let(number, rounded)
    elif fmt == "date:indian-ddmmyyyy":
        shaped = let(indian_date(text), lambda day: _result(F.coalesce(day, text), day.isNotNull()))
    elif fmt.startswith("regex:"):
        pattern = fmt.split(":", 1)[1]
        shaped = _result(text, text.rlike(rf"\A(?:{pattern})\z"))
    else:
        shaped = _result(text, yes)
    empty = F.coalesce(value, F.lit("")) == ""
    return F.when(empty, _result(value, yes)).otherwise(shaped)


def normalize_by_key(
    key: Column, value: Column, raw_text: Column, formats: Mapping[str, str | None]
) -> Column:
    """One CASE over the keys of a schema."""
    chain = None
    for name, fmt in formats.items():
        branch = normalize(value, raw_text, fmt)
        chain = F.when(key == name, branch) if chain is None else chain.when(key == name, branch)
    default = normalize(value, raw_text, None)
    return default if chain is None else chain.otherwise(default)
