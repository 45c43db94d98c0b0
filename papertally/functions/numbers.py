"""Lenient numbers, field coercion, call cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts a decimal parser accepts. Spark's own cast also takes "1d" and hex floats.
_NUMBER = r"(?i)\A\s*([+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan))\s*\z"

# Texts that mean "yes" in a check field.
TRUE_WORDS = ["1", "true", "yes", "y", "on", "checked"]

# Confidence bands.
BAND_HIGH = 0.85
BAND_MID = 0.6


def try_double(c: Column) -> Column:
    """Double from text, null when it is not a number; thousands commas ignored."""
    text = F.replace(c.cast("string"), F.lit(","), F.lit(""))
    return F.regexp_extract(text, _NUMBER, 1).try_cast("double")


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def flt(c: Column) -> Column:
    """Double, 0 for null or junk."""
    return F.coalesce(try_double(c), F.lit(0.0))


def try_int(c: Column) -> Column:
    """Integer truncated toward zero; null for junk or out of range."""
    return try_double(c).try_cast("bigint")


def cint(c: Column) -> Column:
    """Integer, 0 for null or junk."""
    return F.coalesce(try_int(c), F.lit(0).cast("bigint"))


def confidence_band(c: Column) -> Column:
    score = F.coalesce(c, F.lit(0.0))
    return (
        F.when(score >= BAND_HIGH, F.lit("hi")).when(score >= BAND_MID, F.lit("mid")).otherwise(F.lit("lo"))
    )


def coerce_value(fieldtype: Column, value: Column) -> Column:
    """Typed text of a value; a value that does not fit its type is kept raw."""
    text = F.nullif(F.trim(value), F.lit(""))
    date_text = F.coalesce(F.try_to_date(text), F.try_to_timestamp(text).cast("date")).cast("string")
    stamp_text = F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd HH:mm:ss")
    typed = (
        F.when(fieldtype == "Check", F.when(F.lower(text).isin(TRUE_WORDS), F.lit("1")).otherwise(F.lit("0")))
        .when(fieldtype == "Int", try_int(text).cast("string"))
        .when(fieldtype.isin("Float", "Currency", "Percent"), flt(text).cast("string"))
        .when(fieldtype == "Date", date_text)
        .when(fieldtype == "Datetime", stamp_text)
    )
    return F.when(text.isNotNull(), F.coalesce(typed, text))


def call_cost(
    reported: Column,
    prompt_tokens: Column,
    completion_tokens: Column,
    per_m_input: Column,
    per_m_output: Column,
    status: Column,
) -> Column:
    """``struct(cost, estimated)``: the reported cost, else the rate card, else
    zero (flagged unless the call succeeded)."""
    own = flt(reported)
    pt, ct = cint(prompt_tokens), cint(completion_tokens)
    rated = (pt / F.lit(1e6)) * flt(per_m_input) + (ct / F.lit(1e6)) * flt(per_m_output)
    used = (pt != 0) | (ct != 0)
    cost = F.when(own != 0, own).when(used, rated).otherwise(F.lit(0.0))
    estimated = (
        F.when(own != 0, 0).when(used, 1).when(F.coalesce(status != "Success", F.lit(True)), 1).otherwise(0)
    )
    return F.struct(cost.alias("cost"), estimated.alias("estimated"))
