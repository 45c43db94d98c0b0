"""Fill-in-the-middle texts for training.

A text is cut at two of its token ends into prefix, middle and suffix, which are
put down in another order with marks between. One fullmatch of repeated units
keeps every repetition of its group, so the ends of all tokens, their number and
both cuts come from the match without a loop.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertally.llm.registry import query, table

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FORMED_PERCENT, SPM_PERCENT = 42, 50, 80
#: White space goes with the word after it. Repeats give nothing back, so long texts take one pass.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
UNITS = regex.compile(f"({UNIT})*+")
#: Characters of a batch on its way out, but for a single longer text.
_BATCH_CHARACTERS = 4_000_000
RESULT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def transformed(
    text: str, draws: tuple[int, int, int, int], formed_percent: int = FORMED_PERCENT, spm_percent: int = SPM_PERCENT
) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, lengths of prefix and middle, and output of one text."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    if not text or draws[2] % 100 >= formed_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = (ends[cut - 1] if cut else 0 for cut in (first, last))
    prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    if draws[3] % 100 < spm_percent:
        return n, "spm", a, b - a, suffix + prefix + middle
    return n, "psm", a, b - a, prefix + suffix + middle


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that seed and document decide."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4))


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, formed_percent: int = FORMED_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; further columns are not
    read): ``n`` tokens, ``form`` (``plain``, ``psm`` or ``spm``), ``prefix_chars``
    and ``middle_chars`` in code points (null if plain) and the ``output``.

    A null text counts as empty and stays plain, as does a text that contains a
    mark. Rows with the same doc_id and text come out alike; a null doc_id draws
    like an empty one. Cuts may coincide (a tie), which leaves the middle empty.
    A text is matched whole, however long. An empty table gives no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                rows.append((doc_id, *transformed(text, draws(doc_id, seed), formed_percent, spm_percent)))
                held += len(text)
                if held >= _BATCH_CHARACTERS:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(each, RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [part.split()[0] for part in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from. No text with a mark in it is formed, and
    no mark begins as another ends, so the first mark of each kind is ours."""
    after = lambda mark: F.substring_index(output, mark, -1)
    before = lambda text, mark: F.substring_index(text, mark, 1)
    suffix = F.when(form == "psm", before(after(SUFFIX), MIDDLE)).otherwise(before(after(SUFFIX), PREFIX))
    prefix = F.when(form == "psm", before(after(PREFIX), SUFFIX)).otherwise(before(after(PREFIX), MIDDLE))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, after(MIDDLE), suffix))


SQL = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS i,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS j,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                    OR h3 % 100 >= {FORMED_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
          FROM u),
    p AS (SELECT doc_id, text, n, form, array_to_string(units[1:i], '') AS a, array_to_string(units[i + 1:j], '') AS b,
             array_to_string(units[j + 1:], '') AS z FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b
                  ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p"""


@query("op13_infilling", SQL)
def infilling(spark: SparkSession, folder: str) -> DataFrame:
    rows = fill_in_middle(table(spark, folder, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
