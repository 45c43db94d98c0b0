"""Packing documents into sequences by minimum bin slack.

A document is cut into full windows and one remaining piece. What fills the
windows is decided on the multiset of piece lengths alone, a table of at most
``capacity`` rows however large the corpus is: for each window a subset-sum
over a bitset finds the multiset of lengths with the least slack, backtracking
gives the count of each length, and the window is repeated as often as the
counts allow. Pieces then find their place by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papertally.llm.registry import extended, query, table
from papertally.llm.tokens import END, default_tokenizer, encoder
from papertally.session import written

CAPACITY = 2048


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of the given lengths that comes closest to ``capacity``.

    It holds the longest length (so long pieces are placed while short ones are
    left to fill up), then of all fillings one with the largest sum, long pieces
    first. ``counts`` has how many pieces of each length there are.
    """
    lengths = sorted(counts, reverse=True)
    first = lengths[0]
    room = capacity - first
    reached, stages = 1, []
    for length in lengths:
        if length > room:
            continue
        most = min(counts[length] - (length == first), room // length)
        if most <= 0:
            continue
        stages.append((length, most, reached))
        # all multiples up to ``most``, by doubling the number that is covered
        covered = 1
        while covered <= most:
            step = min(covered, most + 1 - covered)
            reached |= reached << (length * step)
            covered += step
        reached &= (1 << (room + 1)) - 1
        if reached >> room:
            break
    total, picked = reached.bit_length() - 1, {first: 1}
    for length, most, before in reversed(stages):
        used = next(u for u in range(most + 1) if total >= u * length and before >> (total - u * length) & 1)
        if used:
            picked[length] = picked.get(length, 0) + used
            total -= used * length
    return picked


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Windows for all pieces: (count of each length in it, how often it occurs)."""
    left = {length: n for length, n in counts.items() if n}
    plan = []
    while left:
        picked = fullest(left, capacity)
        times = min(left[length] // n for length, n in picked.items())
        plan.append((picked, times))
        for length, n in picked.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return plan


def cut_pieces(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False
) -> DataFrame:
    """The pieces of all ``docs`` (``doc_id``, ``text``; null counts as empty).

    Columns: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``;
    ``ids`` (binary, little-endian unsigned 32-bit) on demand; ``task`` and
    ``rank``, the position among the task's pieces of this length.
    """
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select("doc_id", "text")
    numbers = ("start", "length", "ids_crc32", "doc_tokens", "task", "rank")
    schema = extended(
        rows.select("doc_id").schema, **dict.fromkeys(numbers, "bigint"), **({"ids": "binary"} if with_ids else {})
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = encoder(tokenizer), TaskContext.get().partitionId()
        ranks = [0] * (capacity + 1)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                out, of = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    ids = words.encode(text) + END
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        length = len(piece) // 4
                        of.append(i)
                        row = (start, length, zlib.crc32(piece), n, task, ranks[length])
                        out.append((*row, piece) if with_ids else row)
                        ranks[length] += 1
                columns = [batch.column("doc_id").take(pa.array(of))]
                for values, field in zip(zip(*out), schema.fields[1:]):
                    kind = pa.binary() if field.name == "ids" else pa.int64()
                    columns.append(pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(cut, schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset``.

    ``pieces`` comes from a written table (it is read three times) with
    ``length``, ``task`` and ``rank``; these two are dropped, other columns stay.
    Sequences are numbered from 0 without gaps.
    """
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select("task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    # one row a length: at most ``capacity``
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}

    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = dict.fromkeys(counts, 0), 0
    for picked, times in plan_windows(counts, capacity):
        offset = 0
        for length, n in picked.items():
            slots.setdefault(length, []).append((taken[length], times, sequence, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    lookup = {length: np.array(rows, np.int64).T for length, rows in slots.items()}

    ranked = pieces.join(firsts, ["task", "length"]).withColumn("rank", F.col("_first") + F.col("rank"))
    ranked = ranked.drop("task", "_first")
    schema = extended(ranked.drop("rank").schema, sequence_id="bigint", offset="bigint")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequences, offsets = np.empty_like(ranks), np.empty_like(ranks)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                first, times, base, offset = lookup[length]
                k = np.searchsorted(first, ranks[at], "right") - 1
                nth, turn = np.divmod(ranks[at] - first[k], times[k])
                sequences[at] = base[k] + turn
                offsets[at] = offset[k] + nth * length
            kept = [batch.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequences), pa.array(offsets)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places: ``doc_id``, ``start``,
    ``length``, ``ids_crc32``, ``doc_tokens``, (``ids``), ``sequence_id``,
    ``offset``. Other columns of ``docs`` are not read. An empty table gives no
    rows; a repeated row is packed as often as it occurs. Encoding and the count
    of lengths run at once (two actions)."""
    pieces = written(cut_pieces(docs, capacity, tokenizer, with_ids))
    columns = [c for c in pieces.columns if c not in ("task", "rank")]
    return pack_pieces(pieces, capacity).select(*columns, "sequence_id", "offset")


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Whole sequences from pieces with ``ids``: ``sequence_id``, ``length`` and
    ``ids``, in binary. A sequence has at most ``capacity`` ids, so no group is
    larger than that."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_p")).select(
        "sequence_id",
        "length",
        F.unhex(F.array_join(F.transform("_p", lambda p: F.hex(p["ids"])), "")).alias("ids"),
    )


@query("op2_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
