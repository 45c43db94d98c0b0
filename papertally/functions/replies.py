"""Model replies: tolerant JSON, image redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertally.config import let

_FENCE = r"(?s)\A```(?:json)?\s*(.*?)\s*```\z"
# what ``\s`` stands for
_BLANKS = " \t\n\x0b\f\r"


def parse_reply(reply: Column) -> Column:
    """VARIANT of a reply, null if no JSON is found.

    A fence around the whole text is removed first. The text itself is tried,
    then the part from the first ``{`` to the last ``}``, then the same with
    brackets; commas before a closing mark are dropped only in the last two.
    """
    text = F.btrim(reply, F.lit(_BLANKS))
    # a text that is no fence does not match and stays as it is
    body = F.when(text.startswith("```"), F.regexp_replace(text, _FENCE, "$1")).otherwise(text)

    def block(body: Column, pattern: str) -> Column:
        return F.try_parse_json(F.regexp_replace(F.regexp_extract(body, pattern, 0), r",\s*([}\]])", "$1"))

    def attempts(body: Column) -> Column:
        return F.coalesce(F.try_parse_json(body), block(body, r"(?s)\{.*\}"), block(body, r"(?s)\[.*\]"))

    parsed = let(body, attempts)
    return F.get(F.filter(F.array(parsed), lambda v: ~F.is_variant_null(v)), F.lit(0))


def redact_images(payload: Column) -> Column:
    """Replace the url of every ``image_url`` part by a note of its length.

    Works on the text, so the rest of the payload is kept byte for byte; the
    length is that of the url as written in the payload.
    """
    part = r'("image_url"\s*:\s*\{\s*"url"\s*:\s*")((?:[^"\\]|\\.)*)(")'

    def redacted(fragment: Column) -> Column:
        length = F.length(F.regexp_extract(fragment, part, 2)).cast("string")
        note = F.concat(F.lit("<image redacted: "), length, F.lit(" chars>"))
        return F.concat(F.regexp_extract(fragment, part, 1), note, F.lit('"'))

    return F.aggregate(
        F.array_distinct(F.regexp_extract_all(payload, F.lit(part), F.lit(0))),
        payload,
        lambda text, fragment: F.replace(text, fragment, redacted(fragment)),
    )
