"""Language-model scores by Katz backoff.

N-grams are counted, small counts are discounted by Good-Turing, and what a
context's seen words leave over is spread on the others in proportion to the
next lower order, so that each context sums to one exactly.

Counting and lookup go together. Texts are taken in blocks of a bounded number
of tokens. A block sends its distinct n-grams, with their counts, to the
partitions of the count tables, in which each key has its place by hash; a
partition adds up, stores its table and answers each block in the order asked.
A key of a third of all tokens so costs one entry a block. Blocks then score
their texts, and ask in a second round for the backoff weights they need.

Words and n-grams go by hashes of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from papertally.llm.registry import query, table
from papertally.session import shared_path

#: Tokens of a block, but for a single longer text; entries of a table partition.
BLOCK_TOKENS, PARTITION_ENTRIES = 700_000, 1 << 21
#: Counts up to this are discounted by Good-Turing; larger ones by this amount,
#: so that every context leaves something to the words it has not seen.
CUTOFF, RELIABLE = 5, 0.1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
MESSAGE = "kind int, part int, block bigint, keys binary, values binary, numbers array<double>"
_NAMES = ["kind", "part", "block", "keys", "values", "numbers"]


def learned_row() -> Column:
    """Is a row one to learn from? A null doc_id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(True))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _joined(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = history * _A + word * _B
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _squeeze(values: np.ndarray) -> bytes:
    """An array, its bytes by place, compressed."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueeze(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, as steps."""
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _unsqueeze_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unsqueeze(data, "<u8"), dtype=np.uint64)


class Block:
    """The n-grams of some texts: for each order the distinct keys, the place of
    each token's n-gram among them, and how often they occur in learned texts."""

    def __init__(self, number: int, order: int):
        self.number, self.order = number, order
        self.docs: list[tuple] = []  # (doc_id, learned, tokens)
        self._tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, learned: bool, hashes: np.ndarray) -> None:
        self.docs.append((doc_id, learned, len(hashes)))
        self._tokens.append(hashes)
        self.size += len(hashes)

    def finish(self) -> None:
        words = np.concatenate(self._tokens)
        self._tokens = []
        sizes = np.array([n for _, _, n in self.docs])
        self.firsts = np.cumsum(sizes) - sizes
        self.learned = np.repeat(np.array([x for _, x, _ in self.docs], bool), sizes)
        keys = words
        self.keys, self.place, self.counts, self.history = [], [], [], [None]
        for order in range(1, self.order + 1):
            if order > 1:
                # what stands before each token; at a text's start, start marks
                before = np.empty_like(keys)
                before[1:] = keys[:-1]
                marks = _START
                for _ in range(order - 2):
                    marks = _joined(np.array([marks]), np.array([_START]))[0]
                before[self.firsts] = marks
                self.history.append(before)
                keys = _joined(before, words)
            distinct, place = np.unique(keys, return_inverse=True)
            self.keys.append(distinct)
            self.place.append(place.astype(np.int32))
            self.counts.append(np.bincount(place[self.learned], minlength=len(distinct)))


def _blocks(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[Block]:
    """The texts of a task in blocks, numbered by task and position."""
    first, memo = TaskContext.get().partitionId() << 24, _Words()
    block = Block(first, order)
    for batch in batches:
        ids, learned, texts = (batch.column(c) for c in ("doc_id", "learned", "text"))
        for i, text in enumerate(texts.to_pylist()):
            words = text.encode().lower().split() if text else []
            hashes = np.empty(len(words) + 1, np.uint64)
            hashes[:-1] = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
            hashes[-1] = _END
            block.add(ids[i].as_py(), learned[i].as_py(), hashes)
            if block.size >= BLOCK_TOKENS:
                block.finish()
                yield block
                block = Block(block.number + 1, order)
    if block.docs:
        block.finish()
        yield block


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_NAMES)


def _parted(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where ascending keys pass from one table partition to the next."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def count_requests(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """Messages of the blocks to the count tables: distinct keys and counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, order):
            for kind in range(1, order + 1):
                keys, counts = block.keys[kind - 1], block.counts[kind - 1].astype("<u4")
                ends = _parted(keys, bits)
                yield _messages([
                    (kind, p, block.number, _squeeze_keys(keys[a:b]), _squeeze(counts[a:b]), None)
                    for p, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b
                ])

    return docs.mapInArrow(ask, MESSAGE)


def counted(group: pa.Table) -> pa.Table:
    """One partition of a count table: the totals for each block in the order
    asked, with a mark on keys that this block is the first to know (bit 31); and,
    as block -1, the table itself and how many keys have each small count."""
    group = group.sort_by("block")
    kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
    keys = [_unsqueeze_keys(k) for k in group.column("keys").to_pylist()]
    counts = np.concatenate([_unsqueeze(v, "<u4") for v in group.column("values").to_pylist()])
    distinct, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    totals = np.bincount(place, counts).astype(np.int64)
    answers = totals.astype(np.uint32)[place]
    answers[first[totals > 0]] |= np.uint32(1 << 31)
    small = np.bincount(np.minimum(totals, CUTOFF + 2), minlength=CUTOFF + 3)
    numbers = [float(totals.sum()), *map(float, small[1:])]
    known = totals > 0
    rows = [(kind, part, -1, _squeeze_keys(distinct[known]), _squeeze(totals[known]), numbers)]
    at = 0
    for block, k in zip(group.column("block").to_pylist(), keys):
        rows.append((kind, part, block, None, _squeeze(answers[at : at + len(k)]), None))
        at += len(k)
    return pa.Table.from_batches([_messages(rows)])


class Discounts:
    """What is left of a count: Good-Turing's ratio up to the cutoff. If the
    numbers of small counts don't fall as it needs (copied texts disturb them),
    they are first smoothed by a line through their logarithms; if even that is
    too flat, the count less a half is taken."""

    def __init__(self, numbers: list[float]):
        self.total, n = numbers[0], numbers[1:]  # n[r-1]: keys with count r; last: all above
        self.types = sum(n)
        ratios = self._ratios_of(n) or self._ratios_of(self._smooth(n))
        ratios = ratios or [(r - 0.5) / r for r in range(1, CUTOFF + 1)]
        self._ratios = np.array([0.0, *ratios])
        lost = sum((1 - x) * r * n[r - 1] for r, x in enumerate(ratios, 1))
        self.left_over = lost + RELIABLE * (self.types - sum(n[:CUTOFF]))

    @staticmethod
    def _smooth(n: list[float]) -> list[float]:
        known = [(math.log(r), math.log(x)) for r, x in enumerate(n[: CUTOFF + 1], 1) if x]
        if len(known) < 2:
            return [0.0] * (CUTOFF + 1)
        slope, height = np.polyfit(*np.array(known).T, 1)
        return [math.exp(height + slope * math.log(r)) for r in range(1, CUTOFF + 2)]

    @staticmethod
    def _ratios_of(n: list[float]) -> list[float] | None:
        if not all(n[:CUTOFF]):
            return None
        common = (CUTOFF + 1) * n[CUTOFF] / n[0]
        if common >= 1:
            return None
        ratios = [((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) for r in range(1, CUTOFF + 1)]
        return ratios if all(0 < x < 1 for x in ratios) else None

    def kept(self, counts: np.ndarray) -> np.ndarray:
        return np.where(
            counts > CUTOFF, counts - RELIABLE, self._ratios[np.minimum(counts, CUTOFF)] * counts
        )


def _answers(files: fs.FileSystem, folder: str, block: Block) -> dict[int, np.ndarray]:
    """The totals that the count tables sent to a block, by order."""
    rows = pq.read_table(f"{folder}/block={block.number}", filesystem=files, columns=["kind", "part", "values"])
    rows = rows.sort_by([("kind", "ascending"), ("part", "ascending")])
    found: dict[int, list[np.ndarray]] = {}
    for kind, data in zip(rows.column("kind").to_pylist(), rows.column("values").to_pylist()):
        found.setdefault(kind, []).append(_unsqueeze(data, "<u4"))
    totals = {kind: np.concatenate(parts) for kind, parts in found.items()}
    for kind in range(1, block.order + 1):
        if len(totals.get(kind, ())) != len(block.keys[kind - 1]):
            raise RuntimeError("the texts of a task changed between two readings: write them to a table first")
    return totals


SCORED = MESSAGE + ", doc_id {id}, place int, held_out boolean, n_tokens bigint, n_known bigint, base double, seen double"


def score_blocks(
    docs: DataFrame, order: int, bits: int, answers: str, discounts: list[Discounts], n_learned: int
) -> DataFrame:
    """The second reading. Gives, told apart by ``kind``: texts (0) with their
    base score and what is known of their score; and for each order above 1
    messages to the backoff tables: as values what a block's first-known n-grams
    take from their context, as numbers the contexts it asks for."""
    first = discounts[0]
    total, types = first.total, first.types
    unknown = math.log10(0.1 / (total + 0.1 * (types + 1)))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    id_kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(answers)
        for block in _blocks(batches, order):
            totals = _answers(files, folder, block)
            counts = {k: (v & np.uint32((1 << 31) - 1)).astype(np.int64) for k, v in totals.items()}
            mine = {k: (v >> np.uint32(31)).astype(bool) for k, v in totals.items()}
            c = counts[1]
            base = np.where(c > 0, np.log10((c + 0.1) / (total + 0.1 * (types + 1))), unknown)
            # probabilities of the distinct words, then of the distinct n-grams seen
            lower = np.where(c > 0, first.kept(c) / max(total, 1), first.left_over / total if total else 1.0)
            per_token = lower[block.place[0]]
            score = np.log10(per_token)
            asked: list[tuple[int, np.ndarray, np.ndarray]] = []
            messages = []
            for kind in range(2, order + 1):
                at = np.zeros(len(block.keys[kind - 1]), np.int64)
                at[block.place[kind - 1]] = np.arange(block.size)  # a token of each distinct n-gram
                context = np.empty(block.size, np.int64)
                context[1:] = counts[kind - 1][block.place[kind - 2]][:-1]
                context[block.firsts] = n_learned
                n = counts[kind]
                seen = n > 0
                p = np.zeros(len(n))
                p[seen] = discounts[kind - 1].kept(n[seen]) / context[at[seen]]
                # what contexts give to the n-grams that this block is first to know
                own = mine[kind] & seen
                histories, group = np.unique(block.history[kind - 1][at[own]], return_inverse=True)
                given = np.bincount(group, p[own], len(histories))
                lower_given = np.bincount(group, per_token[at[own]], len(histories))
                hit = seen[block.place[kind - 1]]
                per_token = np.where(hit, p[block.place[kind - 1]], per_token)
                score = np.where(hit, np.log10(np.maximum(per_token, 1e-300)), score)
                asked = [(k, t[~hit[t]], h[~hit[t]]) for k, t, h in asked]
                backed = np.flatnonzero(~hit & (context > 0))
                asked.append((kind, backed, block.history[kind - 1][backed]))
                ends = _parted(histories, bits)
                messages += [
                    (kind, part, block.number, _squeeze_keys(histories[a:b]),
                     _squeeze(np.concatenate((given[a:b], lower_given[a:b]))), None)
                    for part, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b
                ]
            owner = np.repeat(np.arange(len(block.docs)), [n for _, _, n in block.docs])
            for kind, tokens, histories in asked:
                wanted, place = np.unique(histories, return_inverse=True)
                ends = _parted(wanted, bits)
                # the numbers mark a question; its texts come with it, to be added up
                messages += [
                    (kind, part, block.number, _squeeze_keys(wanted[a:b]), None, [1.0])
                    for part, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b
                ]
                if len(wanted):
                    texts = _squeeze(np.stack((owner[tokens], place)).astype("<u4").reshape(-1))
                    messages.append((-kind, 0, block.number, None, texts, None))
            add = lambda x: np.bincount(owner, x, len(block.docs))
            known = add((c > 0)[block.place[0]].astype(float)).astype(np.int64)
            ids, learned, sizes = zip(*block.docs)
            n = len(ids)
            rows = [(0, 0, block.number, None, None, None)] * n + messages
            extra = [
                pa.array([*ids, *[None] * len(messages)], id_kind),
                pa.array([*range(n), *[None] * len(messages)], pa.int32()),
                pa.array([*[not x for x in learned], *[None] * len(messages)], pa.bool_()),
                pa.array([*sizes, *[None] * len(messages)], pa.int64()),
                pa.array([*known.tolist(), *[None] * len(messages)], pa.int64()),
                pa.array([*add(base[block.place[0]]).tolist(), *[None] * len(messages)], pa.float64()),
                pa.array([*add(score).tolist(), *[None] * len(messages)], pa.float64()),
            ]
            whole = pa.RecordBatch.from_arrays([*_messages(rows).columns, *extra], names=names)
            for k in range(0, whole.num_rows, 2000):
                yield whole.slice(k, 2000)

    schema = SCORED.format(id=id_type)
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]
    return docs.mapInArrow(read, schema)


def weighed(group: pa.Table) -> pa.Table:
    """One partition of a backoff table: the logarithm of the weight of each
    context, the share it leaves over that its unseen words have in the order
    below; for each block in the order asked, and as block -1 the table itself."""
    group = group.sort_by("block")
    kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
    rows = list(zip(*(group.column(c).to_pylist() for c in ("block", "keys", "values"))))
    given = [(_unsqueeze_keys(k), _unsqueeze(v, "<f8")) for _, k, v in rows if v is not None]
    keys = np.concatenate([k for k, _ in given]) if given else np.empty(0, np.uint64)
    distinct, place = np.unique(keys, return_inverse=True)
    halves = [v.reshape(2, -1) for _, v in given]
    upper, lower = (
        np.bincount(place, np.concatenate([h[i] for h in halves]) if halves else [], len(distinct)) for i in (0, 1)
    )
    weights = np.log10(np.maximum(1 - upper, 1e-12) / np.maximum(1 - lower, 1e-12))
    out = [(kind, part, -1, _squeeze_keys(distinct), _squeeze(weights), None)]
    for block, asked, values in rows:
        if values is None:
            asked = _unsqueeze_keys(asked)
            out.append((kind, part, block, None, _squeeze(weights[np.searchsorted(distinct, asked)]), None))
    return pa.Table.from_batches([_messages(out)])


def backed_off(_: tuple, texts: pa.Table, weights: pa.Table) -> pa.Table:
    """Per text of a block: the sum of the weights its tokens ask for."""
    found: dict[int, float] = {}
    weights = weights.sort_by("part")
    for kind, data in zip(texts.column("kind").to_pylist(), texts.column("values").to_pylist()):
        parts = [
            _unsqueeze(v, "<f8")
            for k, v in zip(weights.column("kind").to_pylist(), weights.column("values").to_pylist())
            if k == -kind
        ]
        owner, place = _unsqueeze(data, "<u4").reshape(2, -1)
        sums = np.bincount(owner, np.concatenate(parts)[place])
        for text in np.unique(owner).tolist():
            found[text] = found.get(text, 0.0) + float(sums[text])
    block = texts.column("block")[0].as_py()
    return pa.table({
        "block": pa.array([block] * len(found), pa.int64()), "place": pa.array(list(found), pa.int32()),
        "weight": pa.array(list(found.values()), pa.float64()),
    })


def score_texts(docs: DataFrame, order: int = 2, folder: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; null counts as empty):
    ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``, the model's log10 probability of the text.

    Learned from are the rows of ``learned_row``. ``folder`` gets the tables:
    counts and backoff weights, a row a partition. With no learned text every
    token is the unknown one. Repeated rows count as often as they occur; other
    columns are not read. ``docs`` must give the same rows to the same tasks
    when it is read again, as tables do; else an error says so. Counts, answers
    and weights are written at once (actions).
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", learned_row().alias("learned"), "text")
    size = rows.agg(
        F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("learned").cast("int")).alias("learned")
    ).first()
    n_learned = size["learned"] or 0
    wanted = max(64, (size["bytes"] or 0) // 6 // PARTITION_ENTRIES)
    bits = max(1, math.ceil(math.log2(wanted)))

    folder = folder or shared_path(spark)
    tables = count_requests(rows, order, bits).groupBy("kind", "part").applyInArrow(counted, MESSAGE)
    answers = f"{folder}/counts"
    # one file a block, which the second reading looks up; block -1 is the table
    tables.withColumn("_deal", F.when(F.col("block") < 0, F.col("part"))).repartition("block", "_deal").drop(
        "_deal"
    ).write.partitionBy("block").parquet(answers)
    if n_learned or size["bytes"] is not None:
        stored = spark.read.schema(MESSAGE).parquet(answers).where("block = -1")
        each = stored.select("kind", F.posexplode("numbers").alias("i", "x")).groupBy("kind", "i").agg(F.sum("x").alias("x"))
        numbers: dict[int, dict[int, float]] = {}
        for r in each.collect():  # a few numbers an order
            numbers.setdefault(r["kind"], {})[r["i"]] = r["x"]
    else:
        numbers = {}
    zeros = dict.fromkeys(range(CUTOFF + 3), 0.0)
    discounts = [Discounts([x for _, x in sorted((numbers.get(k) or zeros).items())]) for k in range(1, order + 1)]

    read = score_blocks(rows, order, bits, answers, discounts, n_learned)
    read.write.partitionBy("kind").parquet(f"{folder}/blocks")
    blocks = spark.read.schema(read.schema).parquet(f"{folder}/blocks")
    asked = blocks.where("kind > 1").select(*_NAMES)
    weights = asked.groupBy("kind", "part").applyInArrow(weighed, MESSAGE)
    weights.write.parquet(f"{folder}/weights")
    weights = spark.read.schema(MESSAGE).parquet(f"{folder}/weights").where("block >= 0").select("kind", "part", "block", "values")
    waiting = blocks.where("kind < 0").select("kind", "block", "values")
    added = waiting.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(
        backed_off, "block bigint, place int, weight double"
    )
    texts = blocks.where("kind = 0")
    return texts.join(added, ["block", "place"], "left").select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(int(discounts[0].total)).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("seen") + F.coalesce("weight", F.lit(0.0))).alias("score"),
    )


@query("op8_katz")
def katz(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"))
