"""Phrases whose words belong together, mined by Toivonen's method.

A sample of the documents proposes phrases. A pass over all documents counts
what was proposed together with its negative border: every phrase that was not
proposed although its two parts of one word less were. Where a phrase of the
border turns out frequent, the sample has failed there; it joins the proposed
ones, and a further pass counts what they let in, until no border fails. Then
every frequent phrase has been counted.

Documents are cut into words once. Blocks of a bounded number of words, with a
dictionary each, are written as a table, and all passes read it. In passes words
and phrases go by hashes of 64 bits, and what is proposed reaches the tasks as a
bit filter of bounded size. A filter or hash that takes one phrase for another
only lets more be counted; the last pass counts the words of what is left over,
so the counts are those of texts.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papertally.llm.registry import query, table
from papertally.session import shared_path, written

#: Words of a phrase at most, and how often it must occur.
WORDS, SUPPORT = 4, 30
#: One document in so many is in the sample, in which a phrase must occur so often.
SAMPLE, SAMPLE_SUPPORT = 8, 2
SCALE, COVERED_PERCENT, BEST = 2_000_000, 80, 2000
#: Tokens of a block, and bytes that are cut into words at once.
BLOCK_TOKENS, CHUNK_BYTES = 1_000_000, 4_000_000
#: Bits of a filter: so many a phrase, within bounds, and set in so many places.
BITS_EACH, LEAST_BITS, MOST_BITS, PLACES = 16, 1 << 16, 1 << 29, 3
_APART = 17
NO_LANGUAGE = "und"

#: Bytes that no UTF-8 text has, for the ends of pieces and documents.
_PIECE, _DOCUMENT = b"\xff", b"\xfe"
_GAP = re.compile(b"[ \xff]")
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(
    0xFF if b in _ENDS else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)
BLOCKS = "lang string, number bigint, carried int, n bigint, words binary, tokens binary"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Dictionary(dict):
    """Words by their number; 0 ends a piece, 1 a document."""

    def __init__(self):
        super().__init__({_PIECE: 0, _DOCUMENT: 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Open:
    """A block of one language that still takes tokens. ``carried`` of them, at
    its beginning, were in the block before."""

    def __init__(self, carried: list[bytes] = ()):
        self.words, self.parts, self.carried = _Dictionary(), [], len(carried)
        self.size = 0
        self.add(carried)

    def add(self, tokens: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens)))
        self.size += len(tokens)

    def row(self, lang: str, number: int) -> tuple:
        tokens = np.concatenate(self.parts)
        n = int((tokens[self.carried :] > 1).sum())
        packed = zstandard.ZstdCompressor(level=1).compress
        planes = tokens.view(np.uint8).reshape(-1, 4).T.tobytes()
        return lang, number, self.carried, n, packed(b"\n".join(list(self.words)[2:])), packed(planes)


def _chunks(text: bytes) -> Iterator[list[bytes]]:
    """A text's tokens, a bounded number of bytes at a time (a word stays whole)."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = at + CHUNK_BYTES
        if end < len(text):
            end = found.start() if (found := _GAP.search(text, end)) else len(text)
        yield text[at:end].replace(_PIECE, b" \xff ").split()
        at = end


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, opened = TaskContext.get().partitionId() << 32, {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = text.as_py()
            if lang not in opened:
                opened[lang] = _Open()
            tail = []
            for tokens in _chunks(text or b""):
                opened[lang].add(tokens)
                tail = (tail + tokens[-(WORDS - 1) :])[-(WORDS - 1) :]
                if opened[lang].size >= BLOCK_TOKENS:
                    # the text may go on: its last words begin the next block, too
                    number += 1
                    yield _block(opened[lang].row(lang, number))
                    opened[lang] = _Open(tail)
            opened[lang].add([_DOCUMENT])
            if sum(block.size for block in opened.values()) >= BLOCK_TOKENS:
                for name, block in opened.items():
                    number += 1
                    yield _block(block.row(name, number))
                opened = {}
    for name, block in opened.items():
        number += 1
        yield _block(block.row(name, number))


def _block(row: tuple) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    names = [part.split()[0] for part in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)


def word_blocks(docs: DataFrame) -> DataFrame:
    """The words of all documents as a written table of blocks (``BLOCKS``)."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    return written(docs.select(lang, F.col("text").cast("binary").alias("text")).mapInArrow(_encode, BLOCKS))


def _joined(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = left * _A + word * _B
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """A block as the passes read it: the hash of each token and which are words.
    Hashes of a word differ by language."""

    def __init__(self, lang: str, number: int, carried: int, words: bytes, tokens: bytes):
        unpacked = zstandard.ZstdDecompressor().decompress
        planes = np.frombuffer(unpacked(tokens), np.uint8)
        self.tokens = np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view(np.int32)
        raw = unpacked(words)
        self.words = raw.split(b"\n") if raw else []
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hashes = np.zeros(len(self.words) + 2, np.uint64)
        self.hashes[2:] = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        self.number, self.carried = number, carried

    def sampled(self) -> np.ndarray:
        """Which tokens are of documents in the sample: drawn by block and position."""
        document = np.cumsum(self.tokens == 1).astype(np.uint64)
        document -= (self.tokens == 1).astype(np.uint64)
        return _joined(document, np.array([self.number], np.uint64)) % np.uint64(SAMPLE) == 0


class BitFilter:
    """Keys that may be in a set: all of its own, and few others."""

    def __init__(self, bits: np.ndarray):
        self._bits = bits
        self._mask = np.uint64(len(bits) * 8 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for place in range(PLACES):
            at = _place(keys, place) & self._mask
            found &= (self._bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return found


def _place(keys: np.ndarray, number: int) -> np.ndarray:
    """The places of a key are pieces of its bits."""
    return keys >> np.uint64(_APART * number)


def write_filter(keys: DataFrame) -> str | None:
    """Bits for all ``key`` of a written table, as a table in the shared folder;
    ``None`` for an empty one. The number of bits is a power of two, so a larger
    filter of more keys holds all a smaller one of some of them does."""
    spark = keys.sparkSession
    n = keys.count()
    if not n:
        return None
    bits = min(max(LEAST_BITS, 1 << (n * BITS_EACH - 1).bit_length()), MOST_BITS)
    places = [F.shiftrightunsigned("key", _APART * i).bitwiseAND(F.lit(bits - 1)) for i in range(PLACES)]
    at = keys.select(F.explode(F.array(*places)).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    path = shared_path(spark)
    filled = at.groupBy(F.shiftright("at", 6).alias("at")).agg(F.bit_or(bit).alias("bits"))
    filled.withColumn("size", F.lit(bits)).write.parquet(path)
    return path


_FILTERS: dict[str, BitFilter] = {}


def _filter(path: str | None) -> BitFilter | None:
    """A filter, read by the task once a worker; the two last used are kept."""
    if path is None:
        return None
    if path not in _FILTERS:
        while len(_FILTERS) > 1:
            del _FILTERS[next(iter(_FILTERS))]
        _FILTERS[path] = BitFilter(_read_bits(path))
    return _FILTERS[path]


def _read_bits(path: str) -> np.ndarray:
    store, root = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    whole = None
    for info in store.get_file_info(fs.FileSelector(root)):
        if posixpath.basename(info.path)[0] in "_." or not info.size:
            continue
        for part in pq.ParquetFile(store.open_input_file(info.path)).iter_batches(1 << 20):
            if whole is None:
                whole = np.zeros(part.column("size")[0].as_py() // 64, np.int64)
            whole[part.column("at").to_numpy()] = part.column("bits").to_numpy()
    return whole.view(np.uint8)


def _eligible(block: Block, known: BitFilter | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of each number of words: the places at which they begin and
    their keys, where both parts of one word less are ``known``. Words all are."""
    words = block.hashes[block.tokens]
    places = np.flatnonzero(block.tokens > 1)
    keys = words[places]
    for k in range(1, WORDS + 1):
        if k > 1:
            if known is None:
                return
            at = np.zeros(len(words) + 1, bool)
            if k == 2:
                in_dictionary = known.has(block.hashes)
                in_dictionary[:2] = False
                at[:-1] = in_dictionary[block.tokens]
            else:
                at[places[known.has(keys)]] = True
            whole = np.zeros(len(words), np.uint64)
            whole[places] = keys
            places = np.flatnonzero(at[:-1] & at[1:])
            keys = _joined(whole[places], words[places + k - 1])
        yield places, keys


def _counts(k: int, keys: np.ndarray) -> pa.RecordBatch:
    distinct, n = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(n), k, np.int32)), pa.array(distinct.view(np.int64)), pa.array(n)], names=["k", "key", "n"]
    )


COUNTS = "k int, key bigint, n bigint"
_READ = ["lang", "number", "carried", "words", "tokens"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Block]]:
    for batch in batches:
        for row in range(batch.num_rows):
            values = [batch.column(c)[row].as_py() for c in _READ]
            yield values[0], Block(*values)


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, block in _blocks(batches):
        taken = block.sampled()
        words = block.hashes[block.tokens]
        places = np.flatnonzero(taken & (block.tokens > 1))
        keys = words[places]
        for k in range(1, WORDS + 1):
            if k > 1:
                at, whole = np.zeros(len(words) + 1, bool), np.zeros(len(words), np.uint64)
                at[places], whole[places] = True, keys
                places = np.flatnonzero(at[:-1] & at[1:])
                keys = _joined(whole[places], words[places + k - 1])
            counted = places + k > block.carried
            yield _counts(k, keys[counted])


def _pass_counts(new: str | None, old: str | None, first: bool):
    """Counts of all phrases that ``new`` lets in and ``old``, in the pass
    before, did not."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches):
            before = iter(()) if first else _eligible(block, _filter(old))
            for k, (places, keys) in enumerate(_eligible(block, _filter(new)), 1):
                counted = places + k > block.carried
                if (counted_before := next(before, None)) is not None:
                    done = np.zeros(len(block.tokens), bool)
                    done[counted_before[0]] = True
                    counted &= ~done[places]
                if counted.any():
                    yield _counts(k, keys[counted])

    return each


def frequent_keys(blocks: DataFrame, support: int) -> DataFrame:
    """``key`` and ``k`` of every phrase of up to ``WORDS`` words that occurs at
    least ``support`` times, by the passes told above (a written table)."""
    total = lambda counts: counts.groupBy("k", "key").agg(F.sum("n").alias("n"))
    source = blocks.select(*_READ)
    proposed = written(total(source.mapInArrow(_sample_counts, COUNTS)).where(F.col("n") >= SAMPLE_SUPPORT).select("k", "key"))
    known, frequent = proposed, None
    old, first = None, True
    while True:
        new = write_filter(known.where(F.col("k") < WORDS))
        counted = total(source.mapInArrow(_pass_counts(new, old, first), COUNTS))
        found = written(counted.where(F.col("n") >= support).select("k", "key"))
        frequent = found if frequent is None else frequent.union(found)
        failed = found.where(F.col("k") < WORDS).join(known, ["k", "key"], "left_anti")
        failed = written(failed)
        if failed.isEmpty():
            return written(frequent)
        known, old, first = written(known.union(failed)), new, False


PHRASES = "lang string, phrase string, k int, n bigint"


def _phrase_counts(path: str | None):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in _blocks(batches):
            known = _filter(path)
            if known is None:
                return
            number, at = block.tokens.astype(np.int64), np.zeros(len(block.tokens) + 1, bool)
            for k, (places, keys) in enumerate(_eligible(block, known), 1):
                # exact: the number of the phrase but for its last word, and that word's
                if k > 1:
                    key = number[places] * len(block.hashes) + block.tokens[places + k - 1]
                    number = np.zeros(len(block.tokens), np.int64)
                    number[places] = np.unique(key, return_inverse=True)[1]
                kept = places[known.has(keys) & (places + k > block.carried)]
                if not len(kept):
                    continue
                _, firsts, n = np.unique(number[kept], return_index=True, return_counts=True)
                rows = block.tokens[kept[firsts][:, None] + np.arange(k)] - 2
                texts = [b" ".join([block.words[w] for w in row]).decode() for row in rows.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n)), pa.array(texts), pa.array(np.full(len(n), k, np.int32)), pa.array(n)],
                    names=["lang", "phrase", "k", "n"],
                )

    return each


def frequent_phrases(docs: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Every phrase of one to ``WORDS`` words of a language with at least
    ``support`` occurrences (``lang``, ``phrase``, ``k``, ``n``), and the number of
    words of each language (``lang``, ``n``). Both are written tables.

    Of ``docs`` only ``lang`` and ``text`` are read. A null text counts as empty, a
    null language as ``und``; repeated rows count as often as they stand there. A
    very long text is cut into words a chunk at a time and goes over several
    blocks. An empty table gives no phrases.
    """
    blocks = word_blocks(docs)
    path = write_filter(frequent_keys(blocks, support))
    counts = blocks.select(*_READ).mapInArrow(_phrase_counts(path), PHRASES)
    phrases = counts.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    return written(phrases), written(blocks.groupBy("lang").agg(F.sum("n").alias("n")))


def _part(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored_phrases(phrases: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r`` and ``score`` of the phrases of two
    words or more, at the cut that scores lowest (a tie goes to the earlier cut),
    without those that a longer phrase covers. Products are decimals of 38 digits."""
    words = F.split("phrase", " ")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    each = phrases.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), words.alias("words"))
    cuts = each.select("lang", "phrase", "k", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut",
        _part(F.col("words"), 1, F.col("cut")).alias("left"),
        _part(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"),
    )
    counts = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    met = cuts.join(counts("left", "l"), ["lang", "left"]).join(counts("right", "r"), ["lang", "right"])
    score = F.expr(f"CAST(a AS DECIMAL(20,0)) * {SCALE} DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    cut = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    best = met.groupBy("lang", "phrase", "a").agg(cut)
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("k") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: _part(F.col("words"), at, size)),
        )
    )
    longest = each.where("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
    longest = longest.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = wide("longer") * 100 >= wide("a") * COVERED_PERCENT
    return best.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~covered).select(
        "lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score")
    )


def collocations(docs: DataFrame, support: int = SUPPORT, best: int = BEST) -> DataFrame:
    """The first ``best`` phrases of each language by score, then count, then the
    phrase itself: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``,
    ``score``. Ties and awkward rows as told at ``frequent_phrases``."""
    phrases, languages = frequent_phrases(docs, support)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored_phrases(phrases).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return first.join(languages, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


SQL = rf"""
    WITH d AS (SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
    t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
    i AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {WORDS + 1})) AS k)),
    g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS a FROM i GROUP BY ALL),
    f AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND a >= {SUPPORT}),
    c AS (SELECT *, array_to_string(ws[1:c], ' ') AS x, array_to_string(ws[c + 1:], ' ') AS y
          FROM (SELECT *, unnest(range(1, k)) AS c FROM f)),
    s AS (SELECT c.lang, c.phrase, c.a, min({{'score': ({SCALE}::HUGEINT * c.a) // (l.a + r.a), 'c': c.c, 'l': l.a, 'r': r.a}}) AS best
          FROM c JOIN g l ON l.lang = c.lang AND l.phrase = x JOIN g r ON r.lang = c.lang AND r.phrase = y GROUP BY ALL),
    z AS (SELECT lang, phrase, max(a) AS a FROM (
            SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase
            FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f))) GROUP BY ALL),
    o AS (SELECT s.lang, s.phrase, s.a, best.l AS l, best.r AS r, best.score::BIGINT AS score FROM s LEFT JOIN z USING (lang, phrase)
          WHERE z.a IS NULL OR 100::HUGEINT * z.a < {COVERED_PERCENT} * s.a)
    SELECT o.lang, rank, phrase, a, l, r, n, score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) o JOIN t USING (lang)
    WHERE rank <= {BEST}"""


@query("op12_collocations", SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
