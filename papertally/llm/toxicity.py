"""Toxicity by the nearest labelled examples.

Labelled texts, a bounded sample, are the examples. All their letter sequences
are terms; a text is its TF-IDF vector over them, with frequencies counted over
all documents. A term weighs more the more its counts in the examples of both
labels differ; none is left out. The nearest examples by cosine are found exactly
in an inverted index whose postings lie in blocks with the greatest weight of
each term: blocks whose bound cannot better the neighbours at hand are not read.
Neighbours vote by their closeness, counted as often as the sample stands for
labelled rows; the cut between the labels is set on examples that are scored
without themselves. Neighbours are the evidence.
"""

from __future__ import annotations

import math
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertally.llm.registry import extended, query, table
from papertally.session import shared_path, written

#: Bounds of what is fitted: examples of each label, and those of them the cut is set on.
MAX_EXAMPLES, CALIBRATED = 4000, 500
#: Letters of a term, the marks of a word's ends included. Shorter words are a term.
#: Of 5, 6, 7, and 5 with 7, which part the labels alike when training examples are
#: scored without themselves, the shortest: parts of rare words match as well.
SIZE = 5
#: Weight of a term that says nothing about labels, and log-likelihood ratio that adds 1 to it.
FLOOR, SIGNAL = 0.05, 20.0
NEIGHBOURS, BLOCK = 24, 64
#: Blocks of the greatest bounds, read before any is left out.
FIRST_BLOCKS = 16
#: The most frequent terms, up to so many, are kept as a matrix: those that more than
#: one example in ``DENSE_SHARE`` has. Their postings lie in all blocks and bound nothing.
DENSE_TERMS, DENSE_SHARE = 2048, 32
#: Longest word whose terms are kept for its next occurrence, and words kept of each generation.
MEMO_BYTES, MEMO_WORDS = 128, 200_000
#: Texts handled at a time: so many, or as many as hold these letters; one text at least.
BATCH_ROWS, BATCH_LETTERS = 128, 1 << 20
#: How much closeness the base rate counts for.
PRIOR = 0.35
THRESHOLD = 0.7

_MARKS = re.compile(r"[\W_]+")


def trained_row() -> Column:
    """Is a row one to learn from?"""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def word_terms(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All sequences of ``SIZE`` letters of each word as 64-bit hashes, each as
    often as it occurs, and where each word's begin, with the end of the last.

    Words are taken in lower case, without marks, between ``<`` and ``>``. All
    are hashed in one buffer. A word may be a whole text of a script without
    spaces; one of marks alone has no terms.
    """
    found, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    start = 0
    while start < len(words):
        shown, letters = [], 0
        while start < len(words) and letters <= BATCH_LETTERS:
            plain = _MARKS.sub("", words[start].decode(errors="replace").lower())
            shown.append(f"<{plain}>" if plain else "")
            letters += len(shown[-1])
            start += 1
        n = np.fromiter(map(len, shown), np.int64, len(shown))
        ends = np.cumsum(n)
        codes = np.frombuffer("".join(shown).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
        # letters past a word's end count as nothing, so that short words hash alike anywhere
        left = np.repeat(ends, n) - np.arange(len(codes))
        codes = np.append(codes, np.zeros(SIZE - 1, np.uint64))
        rolling = np.zeros(len(left), np.uint64)
        for k in range(SIZE):
            rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, codes[k : k + len(left)], np.uint64(0))
        # a word's own terms: whole sequences, or the short word itself
        starts = (ends - n)[n > 0]
        whole = left >= SIZE
        whole[starts] = True
        hashed = (rolling ^ (rolling >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append(hashed[whole])
        sizes.append(np.where(n > 0, np.maximum(1, n - SIZE + 1), 0))
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


class Counter:
    """The terms of texts and how often each occurs.

    With sorted ``terms``, their places in it, and terms that aren't in it are
    left out; without, hashes. Words are remembered in two generations of
    ``MEMO_WORDS``: when the younger is full it becomes the older one, which is
    forgotten. Words of more than ``MEMO_BYTES`` are cut into terms each time.
    """

    def __init__(self, terms: np.ndarray | None = None):
        self._terms = terms
        self._kind = np.uint64 if terms is None else np.int32
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _learnt(self, words: set[bytes]) -> dict[bytes, bytes]:
        """What each of the words stands for."""
        known = {}
        for word in words:
            found = self._young.get(word)
            if found is None and (found := self._old.get(word)) is not None:
                self._young[word] = found
            if found is not None:
                known[word] = found
        new = [w for w in words if w not in known]
        if new:
            hashes, ends = word_terms(new)
            bounds = ends
            if self._terms is not None:
                if len(self._terms):
                    at = np.minimum(np.searchsorted(self._terms, hashes), len(self._terms) - 1)
                    kept = self._terms[at] == hashes
                else:
                    at, kept = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
                bounds = np.append(0, np.cumsum(kept))[ends]
                hashes = at[kept]
            data, width = hashes.astype(self._kind).tobytes(), np.dtype(self._kind).itemsize
            cuts = (bounds * width).tolist()
            for i, word in enumerate(new):
                known[word] = found = data[cuts[i] : cuts[i + 1]]
                if len(word) <= MEMO_BYTES:
                    self._young[word] = found
        if len(self._young) >= MEMO_WORDS:
            self._old, self._young = self._young, {}
        return known

    def count(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its terms, in order, and their counts."""
        split = [(t or "").encode(errors="replace").lower().split() for t in texts]
        known = self._learnt(set().union(*split))
        joined = (np.frombuffer(b"".join(map(known.__getitem__, words)), self._kind) for words in split)
        return [np.unique(found, return_counts=True) for found in joined]


def slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch in bounded pieces, in order."""
    some: list[str | None] = []
    letters = 0
    for text in texts:
        some.append(text.as_py())
        letters += len(some[-1] or "")
        if len(some) >= BATCH_ROWS or letters >= BATCH_LETTERS:
            yield some
            some, letters = [], 0
    if some:
        yield some


def sampled(labels: DataFrame, seed: str = "tox") -> DataFrame:
    """Examples: ``doc_id``, ``toxic`` and ``stands_for`` (labelled rows per
    example), at most ``MAX_EXAMPLES`` of each label. A doc_id with two labels
    is toxic; null ids and labels are left out."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(trained_row())
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    sides = []
    for toxic in (0, 1):
        side = rows.where(F.col("toxic") == toxic)
        n = side.count()
        stands = max(1.0, n / MAX_EXAMPLES)
        sides.append(side.orderBy(order, "doc_id").limit(MAX_EXAMPLES).withColumn("stands_for", F.lit(stands)))
    return sides[0].unionByName(sides[1])


def signal(n_toxic: np.ndarray, n_clean: np.ndarray, toxic: float, clean: float) -> np.ndarray:
    """Log-likelihood ratio of terms' counts against one rate for both labels."""
    if not toxic or not clean:
        return np.zeros(len(n_toxic))
    rate = (n_toxic + n_clean) / (toxic + clean)
    part = lambda n, e: n * np.log(np.where(n > 0, n, 1) / np.where(n > 0, e, 1))
    found = part(n_toxic, toxic * rate) + part(toxic - n_toxic, toxic * (1 - rate))
    return np.maximum(0, 2 * (found + part(n_clean, clean * rate) + part(clean - n_clean, clean * (1 - rate))))


class Stored:
    """Arrays in a file of the shared folder, read once by each worker, so that
    tasks carry its name alone."""

    _read: dict[str, dict[str, np.ndarray]] = {}

    def __init__(self, path: str):
        self.path = path

    def _file(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        return store, f"{root}/arrays.npz"

    @classmethod
    def of(cls, spark: SparkSession, **arrays: np.ndarray) -> Stored:
        stored = cls(shared_path(spark))
        store, name = stored._file()
        store.create_dir(name.rsplit("/", 1)[0])
        # as a stream: no second copy of all arrays is held
        with store.open_output_stream(name) as out, zipfile.ZipFile(out, "w") as packed:
            for key, value in arrays.items():
                with packed.open(key, "w", force_zip64=True) as part:
                    np.lib.format.write_array(part, np.ascontiguousarray(value))
        return stored

    def arrays(self) -> dict[str, np.ndarray]:
        if self.path not in self._read:
            self._read.clear()  # one model at a time
            store, name = self._file()
            with store.open_input_file(name) as source, zipfile.ZipFile(source) as packed:
                found = {}
                for key in packed.namelist():
                    with packed.open(key) as part:
                        found[key] = np.lib.format.read_array(part)
            self._read[self.path] = found
        return self._read[self.path]


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many rows of ``docs`` each term lies."""

    store = Stored.of(docs.sparkSession, terms=terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = store.arrays()["terms"]
        counter, n = Counter(known), np.zeros(len(known), np.int64)
        for batch in batches:
            for some in slices(batch.column("text")):
                for at, _ in counter.count(some):
                    n[at] += 1
        at = np.flatnonzero(n)
        for i in range(0, len(at), 100_000):
            some = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["term", "n"])

    found = docs.select("text").mapInArrow(counted, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    rows = found.toArrow()
    n = np.zeros(len(terms), np.int64)
    n[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return n


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _arrays(vector) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(vector, tuple):
        return vector
    return np.array([t for t, _ in vector], np.int64), np.array([w for _, w in vector], float)


class BlockMaxIndex:
    """Examples by term, in blocks with the greatest weight of each term.

    ``vectors`` are (term, weight) lists of length 1, or a pair of arrays each;
    examples of the same strongest term lie next to each other, which keeps
    bounds apart. The most frequent terms (``DENSE_TERMS``) stand in every block:
    their part of the cosine is computed for all examples at once, as a product
    of matrices, and enters the bound of a block as its greatest true value.
    """

    #: Arrays that make up an index.
    PARTS = ("order", "places", "weights", "starts", "blocks", "bounds", "of_term", "column", "dense")

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)
        self.n_blocks = -(-len(self.order) // BLOCK)

    @classmethod
    def of(cls, vectors: list, n_terms: int) -> BlockMaxIndex:
        arrays = [_arrays(v) for v in vectors]
        strongest = [(int(t[np.argmax(w)]), -float(w.max())) if len(t) else (-1, 0.0) for t, w in arrays]
        order = np.array(sorted(range(len(arrays)), key=lambda i: (strongest[i], i)), np.int64)
        had = np.zeros(n_terms, np.int64)
        for terms, _ in arrays:
            had[terms] += 1
        frequent = np.argsort(-had, kind="stable")[:DENSE_TERMS]
        frequent = frequent[had[frequent] * DENSE_SHARE > len(order)]
        column = np.full(n_terms, -1, np.int32)
        column[frequent] = np.arange(len(frequent), dtype=np.int32)
        dense = np.zeros((-(-len(order) // BLOCK) * BLOCK, len(frequent)), np.float32)
        total = int(had[column < 0].sum())
        terms, places, weights = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, np.float32)
        end = 0
        for place, i in enumerate(order.tolist()):
            t, w = arrays[i]
            in_matrix = column[t] >= 0
            dense[place, column[t[in_matrix]]] = w[in_matrix]
            start, end = end, end + int((~in_matrix).sum())
            terms[start:end], places[start:end], weights[start:end] = t[~in_matrix], place, w[~in_matrix]
        by_term = np.argsort(terms, kind="stable").astype(np.int32)
        terms, places, weights = terms[by_term], places[by_term], weights[by_term]
        # a segment is the postings of one term in one block
        blocks = (places // BLOCK).astype(np.int32)
        new = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])][: len(terms)])
        return cls(
            order=order,
            places=places,
            weights=weights,
            starts=np.append(new, len(terms)).astype(np.int32),
            blocks=blocks[new],
            bounds=np.maximum.reduceat(weights, new) if len(new) else weights,
            of_term=np.searchsorted(terms[new], np.arange(n_terms + 1)).astype(np.int32),
            column=column,
            dense=dense,
        )

    def nearest(self, vectors: list, k: int) -> list[list[tuple[int, float]]]:
        """For each vector the ``k`` examples of the greatest cosine above 0 with
        it; of equal ones the earlier. Cosines have six digits. Exact: a block is
        left out only if its bound is lower than the k-th cosine found."""
        arrays = [_arrays(v) for v in vectors]
        asked = np.zeros((len(arrays), self.dense.shape[1]), np.float32)
        for row, (terms, weights) in zip(asked, arrays):
            at = self.column[terms]
            row[at[at >= 0]] = weights[at >= 0]
        return [self._nearest(*vector, row, k) for vector, row in zip(arrays, asked @ self.dense.T)]

    def _nearest(self, terms: np.ndarray, query: np.ndarray, base: np.ndarray, k: int) -> list[tuple[int, float]]:
        if not len(terms) or not self.n_blocks:
            return []
        first = self.of_term[terms].astype(np.int64)
        sizes = self.of_term[terms + 1] - first
        segments, weights = _ranges(first, sizes), np.repeat(query, sizes)
        blocks = self.blocks[segments]
        bounds = np.bincount(blocks, weights * self.bounds[segments], self.n_blocks)
        bounds = bounds + base.reshape(self.n_blocks, BLOCK).max(axis=1)
        left = np.argsort(-bounds, kind="stable")
        left = left[bounds[left] > 0]
        best: list[tuple[float, int]] = []
        # the best blocks give the k-th cosine that the others have to reach
        some = left[:FIRST_BLOCKS]
        while len(some):
            taken = np.zeros(self.n_blocks, bool)
            taken[some] = True
            of = np.flatnonzero(taken[blocks])
            starts = self.starts[segments[of]].astype(np.int64)
            n = self.starts[segments[of] + 1] - starts
            at = _ranges(starts, n)
            scores = np.bincount(self.places[at], np.repeat(weights[of], n) * self.weights[at], len(base))
            rows = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            scores = scores[rows] + base[rows]
            least = 0.0
            if len(scores) > k:  # ties of the k-th stay in
                least = max(least, np.partition(scores, -k)[-k] - 1e-5)
            hit = np.flatnonzero(scores > least)
            # places past the last example are empty and score 0
            found = zip(np.round(scores[hit], 6).tolist(), self.order[rows[hit]].tolist())
            best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[:k]
            left = left[len(some) :]
            if len(best) == k:
                left = left[bounds[left] >= best[-1][0] - 1e-5]
            some = left
        return [(i, score) for score, i in best]


class Model:
    """What scoring needs; of bounded size, whatever the corpus.

    ``examples`` are ``ids``, ``toxic`` and ``stands_for``, one per distinct text
    and label. ``rates`` are the rate of label 1 among all examples and among
    those without a term, and the share of the votes at which both labels meet;
    it becomes ``THRESHOLD``.
    """

    PARTS = ("terms", "term_weights", "ids", "toxic", "stands_for")

    def __init__(self, index: BlockMaxIndex, rates: tuple[float, float, float], **parts: np.ndarray):
        self.index, self.parts = index, parts
        self.rate, self.silent, self.cut = rates
        self.terms, self.term_weights = parts["terms"], parts["term_weights"]
        self.ids, self.toxic, self.stands_for = (parts[p].tolist() for p in ("ids", "toxic", "stands_for"))

    def stored(self, spark: SparkSession) -> Stored:
        """The model without its rates as a file."""
        return Stored.of(spark, **{k: getattr(self.index, k) for k in BlockMaxIndex.PARTS}, **self.parts)

    @classmethod
    def read(cls, stored: Stored, rates: tuple[float, float, float]) -> Model:
        arrays = stored.arrays()
        index = BlockMaxIndex(**{k: arrays[k] for k in BlockMaxIndex.PARTS})
        return cls(index, rates, **{k: arrays[k] for k in cls.PARTS})

    def votes(self, counts: list, but: list[int] | None = None) -> list[tuple[float, list[tuple[int, float]]]]:
        """For each text the share of label 1 among the nearest examples, and
        these. The example ``but`` of a text has no vote."""
        vectors = [vector(c, self.term_weights) for c in counts]
        found = []
        for near, own in zip(self.index.nearest(vectors, NEIGHBOURS + (but is not None)), but or [-1] * len(counts)):
            near = [x for x in near if x[0] != own][:NEIGHBOURS]
            votes = [(cosine * self.stands_for[i], self.toxic[i]) for i, cosine in near]
            toxic = sum(v for v, label in votes if label)
            found.append(((toxic + PRIOR * self.rate) / (sum(v for v, _ in votes) + PRIOR), near))
        return found

    def score(self, counts: list) -> list[tuple[float, list[tuple[int | None, float]]]]:
        """For each text how far the votes are for label 1, ``THRESHOLD`` at the
        cut, and the nearest examples (doc_id, cosine). A text without a known
        term gets the rate of such texts among the examples."""
        found = []
        for (at, _), (share, near) in zip(counts, self.votes(counts)):
            if not len(at):
                found.append((self.silent, []))
                continue
            low = share < self.cut
            score = THRESHOLD * share / self.cut if low else THRESHOLD + (1 - THRESHOLD) * (share - self.cut) / (1 - self.cut)
            found.append((min(1.0, max(0.0, score)), [(self.ids[i], cosine) for i, cosine in near[:3]]))
        return found


def vector(counts: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TF-IDF vector of length 1 of a text's terms and their counts."""
    raw = (1 + np.log(counts[1])) * weights[counts[0]]
    return counts[0], raw / math.sqrt(float(raw @ raw) or 1.0)


def _cut(shares: list[tuple[float, int, float]]) -> float:
    """Of (share, toxic, weight) the share that parts labels with the best F1,
    in the middle of a gap."""
    rows = sorted(shares, reverse=True)
    all_toxic = sum(w for _, toxic, w in rows if toxic)
    best, cut, hits, taken = 0.0, THRESHOLD, 0.0, 0.0
    for i, (share, toxic, weight) in enumerate(rows):
        taken += weight
        hits += weight * toxic
        below = rows[i + 1][0] if i + 1 < len(rows) else 0.0
        if below < share and (f1 := 2 * hits / (taken + all_toxic)) > best:
            best, cut = f1, (share + below) / 2
    return min(max(cut, 1e-6), 1 - 1e-6)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Stored, tuple[float, float, float]]:
    """The model's file and rates.

    Only the examples are collected, at most two times ``MAX_EXAMPLES`` (rows of
    one doc_id in ``docs`` count as one example a distinct text), and the
    frequencies of their terms. Without labelled rows there are no terms and
    every score is one half.
    """
    # of a proven size: see MAX_EXAMPLES
    spark, chosen = docs.sparkSession, written(sampled(labels))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("text", "toxic").agg(
        F.min("doc_id").alias("doc_id"), F.sum("stands_for").alias("stands_for")
    )
    rows = texts.orderBy("doc_id", "toxic", "text").toArrow()
    counter, counts = Counter(), []
    for chunk in rows.column("text").chunks:
        for some in slices(chunk):
            # 32-bit counts: many examples are held at once
            counts += [(hashes, n.astype(np.int32)) for hashes, n in counter.count(some)]
    del counter
    ids = rows.column("doc_id").to_numpy()
    toxic = rows.column("toxic").to_numpy().astype(bool)
    stands_for = rows.column("stands_for").to_numpy()
    del rows
    terms = np.zeros(0, np.uint64)
    for i in range(0, len(counts), 500):
        terms = np.unique(np.concatenate([terms, *[c[0] for c in counts[i : i + 500]]]))
    hits = np.zeros((2, len(terms)))
    for i, (hashes, n) in enumerate(counts):
        counts[i] = np.searchsorted(terms, hashes).astype(np.int32), n
        hits[int(toxic[i]), counts[i][0]] += 1
    frequency, n = np.zeros(0, np.int64), 0
    if len(terms):
        frequency, n = document_frequencies(docs, terms), docs.count()
    idf = 1 + np.log((1 + n) / (1 + frequency))
    weights = idf * (FLOOR + signal(hits[1], hits[0], toxic.sum(), (~toxic).sum()) / SIGNAL)
    has_terms = np.array([len(c[0]) > 0 for c in counts], bool)
    share = lambda of: float((stands_for[of & toxic].sum() + 0.5) / (stands_for[of].sum() + 1))
    rates = (share(np.ones(len(toxic), bool)), share(~has_terms), THRESHOLD)
    index = BlockMaxIndex.of([vector(c, weights) for c in counts], len(terms))
    parts = {"terms": terms, "term_weights": weights, "ids": ids, "toxic": toxic, "stands_for": stands_for}
    stored = Model(index, rates, **parts).stored(spark)
    del index
    sides = [np.flatnonzero(has_terms & (toxic == side)).tolist() for side in (False, True)]
    if all(sides):
        shares = calibrated(spark, stored, rates, counts, sides, stands_for)
        rates = (*rates[:2], _cut([(x, int(toxic[i]), weight) for i, weight, x in shares]))
    return stored, rates


def calibrated(
    spark: SparkSession, stored: Stored, rates: tuple, counts: list, sides: list[list[int]], stands_for: np.ndarray
) -> list[tuple[int, float, float]]:
    """(example, weight, share) of up to ``CALIBRATED`` examples a label, evenly
    taken, each scored without itself."""
    rows = []
    for side in sides:
        step = max(1.0, len(side) / CALIBRATED)
        some = [side[int(i * step)] for i in range(min(len(side), CALIBRATED))]
        rows += [(i, float(stands_for[i] * step), counts[i][0].tobytes(), counts[i][1].tobytes()) for i in some]

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.read(stored, rates)
        for batch in batches:
            at, n = ([np.frombuffer(x, np.int32) for x in batch.column(c).to_pylist()] for c in ("at", "n"))
            found = [share for share, _ in model.votes(list(zip(at, n)), but=batch.column("i").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("weight"), pa.array(found, pa.float64())], names=["i", "weight", "share"])

    asked = spark.createDataFrame(rows, "i int, weight double, at binary, n binary")
    got = asked.repartition(spark.sparkContext.defaultParallelism).mapInArrow(shares, "i int, weight double, share double").collect()
    return sorted((r["i"], r["weight"], r["share"]) for r in got)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``,
    ``held_out``, ``score``, ``predicted`` and ``evidence``.

    ``labels`` has ``doc_id`` and ``toxic``. Null and empty texts, and texts
    without a term, get the rate of such texts among the examples. Ties between
    neighbours go to the smaller doc_id. Texts of any length are read whole.
    Other columns are not read. Terms, frequencies and examples are made at once
    (actions).
    """
    stored, rates = fit(docs, labels)
    rows = docs.select("doc_id", "text")
    schema = extended(rows.select("doc_id").schema, score="double", evidence="array<struct<doc_id:bigint,cosine:double>>")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.read(stored, rates)
        counter = Counter(model.terms)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
        for batch in batches:
            found = [x for some in slices(batch.column("text")) for x in model.score(counter.count(some))]
            evidence = [[{"doc_id": i, "cosine": c} for i, c in near] for _, near in found]
            columns = [pa.array([x for x, _ in found], pa.float64()), pa.array(evidence, kind)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=schema.names)

    return rows.mapInArrow(score, schema).select(
        "doc_id",
        F.coalesce(~trained_row(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "evidence",
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is below the threshold."""
    stored, rates = fit(docs, labels)
    kept: list[tuple[Model, Counter]] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not kept:
            model = Model.read(stored, rates)
            kept.append((model, Counter(model.terms)))
        model, counter = kept[0]
        return pa.array([x for some in slices(texts) for x, _ in model.score(counter.count(some))], pa.float64())

    return docs.where(score("text") < THRESHOLD)


@query("op10_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
