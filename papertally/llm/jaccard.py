"""Documents that share most of their word shingles: an exact Jaccard join.

Shingles are hashed; the order of hashes is the global order. A document's
prefix is the start of its ordered set. By how many prefixes a shingle lies in
it is rare or frequent. Rare shingles are indexed singly, frequent ones in
combinations of two from the same part of the hash range. With t shingles that a
partner may lack, the prefix reaches until the rare ones plus, over the parts,
the frequent ones less one are more than t even if all were frequent. So two
similar documents share an index key, whatever the frequencies are: of the one
whose prefix ends first at most t shingles are missing in the other.

Keys of combinations also carry a class of size. Documents of one key are
candidates. In small groups all pairs are named, in large ones those with one
centre. The likeliest candidates are verified first, and most families of
candidates become one component. What could still join components is verified in
blocks: each document outside its family's largest component against the whole
family, a block of shingles by a block of shingles in a task, so that a task's
memory is bounded. A block is written once and read by each task that needs it, so
that disk grows with the sets and not with the pairs of blocks.
Copies (equal sets) are one set throughout. Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertally.llm.components import components
from papertally.llm.fingerprints import keep_rows, row_key
from papertally.llm.registry import extended, query, table
from papertally.session import shared_path, written

#: A shingle in more prefixes is frequent; a key of more sets is a large group.
FREQUENT, LARGE = 12, 4
#: Shingles of a family that meet in one task: so many (32 MB) against so many. A
#: family of fewer than WHOLE is not parted by size first.
BLOCK, WHOLE = 1 << 22, 1 << 18
#: Rows of two short columns that travel to every task, at most (150 MB).
BROADCAST_ROWS = 1_000_000
#: Tasks that pairs of blocks are dealt to, at most.
TASKS = 10_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class _Words(dict):
    """From a word to its hash; bounded in size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64 over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words_each: int, memo: _Words) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(words) < words_each:
        parts = hashes * _FACTORS[: len(words)]
        sums = np.array([np.add.reduce(parts) + np.uint64(len(words))], np.uint64)
    else:
        n = len(words) - words_each + 1
        sums = np.zeros(n, np.uint64)
        for i in range(words_each):
            sums += hashes[i : i + n] * _FACTORS[i]
    return np.unique(_mixed(sums).view(np.int64))


def lacking(n: int, percent: int) -> int:
    """How many of ``n`` shingles a similar document may lack."""
    return n - -(-percent * n // 100)


def size_class(n: int, percent: int) -> int:
    """Similar documents are in the same class or in neighbouring ones."""
    return int(math.log(n) / (math.log(100 / percent) * 1.0001))


@lru_cache(maxsize=4096)
def parts_of(size_key: int, percent: int) -> int:
    """Into how many parts frequent shingles fall: a power of two, so that a part
    has two to five of a prefix."""
    few = (1 - percent / 100) * (100 / percent) ** size_key / 2
    return 1 if few < 8 else 1 << int(math.log2(few))


def prefix_length(ordered: np.ndarray, percent: int) -> int:
    """How far the prefix of a set reaches, for both size keys it has."""
    n = len(ordered)
    may_lack, own = lacking(n, percent), size_class(n, percent)
    length = min(n, may_lack + may_lack // 3 + 2)
    for size_key in (own, own + 1):
        part = ordered & (parts_of(size_key, percent) - 1)
        counts = np.ones(n, np.int64)
        counts[np.unique(part, return_index=True)[1]] = 0  # the first of a part makes no pair
        enough = int(np.searchsorted(np.cumsum(counts), may_lack + 1)) + 1
        length = max(length, min(n, enough))
    return length


def document_sets(docs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, its ``row`` key, ``n_shingles``, ``set_id`` (equal for
    equal sets, null for none), ``need`` (shingles it shares with any similar
    one, at least) and its ``prefix``, which only the first of equal sets in a
    task carries."""
    rows = docs.select("doc_id", row_key().alias("row"), "text")
    schema = extended(
        rows.drop("text").schema, n_shingles="bigint", set_id="bigint", need="int", prefix="array<bigint>"
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = _Words(), set()
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                sizes, ids, needs, prefixes = [], [], [], []
                for text in batch.column("text").to_pylist():
                    ordered = shingle_set(text, words_each, memo)
                    n = len(ordered)
                    sizes.append(n)
                    ids.append(_set_id(ordered) if n else None)
                    needs.append(lacking(-(-percent * n // 100), percent) // 3 + 2)
                    fresh = n > 1 and ids[-1] not in seen
                    if fresh:
                        seen.add(ids[-1])
                    prefixes.append(ordered[: prefix_length(ordered, percent)] if fresh else ordered[:0])
                ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes])))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes)))
                columns = [pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(needs, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *columns], names=schema.names)

    return rows.mapInArrow(sets, schema)


def _set_id(ordered: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(ordered.tobytes(), digest_size=8).digest(), "little", signed=True)


def index_keys(suspects: DataFrame, percent: int) -> DataFrame:
    """``key``, ``set_id``, ``n`` from sets with their shared prefix shingles
    ``shared`` (hash and in how many prefixes it lies)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                out, of = [], []
                for i, (n, shared) in enumerate(zip(batch.column("n").to_pylist(), batch.column("shared").to_pylist())):
                    hashes = np.array([s["h"] for s in shared], np.int64).view(np.uint64)
                    often = np.array([s["df"] > FREQUENT for s in shared], bool)
                    own = size_class(n, percent)
                    out.append(_mixed(hashes[~often] + _FACTORS[3]))
                    of.append(np.full(len(out[-1]), i))
                    for size_key in (own, own + 1):
                        salt = _FACTORS[4:] * np.uint64(size_key)
                        frequent = np.sort(hashes[often])
                        part = frequent & np.uint64(parts_of(size_key, percent) - 1)
                        a, b = np.triu_indices(len(frequent), 1) if len(frequent) < 64 else _pairs_within(part)
                        same = part[a] == part[b]
                        pairs = frequent[a[same]] * _FACTORS[0] + frequent[b[same]] * _FACTORS[1]
                        found = _mixed(pairs + salt)
                        out.append(found)
                        of.append(np.full(len(found), i))
                at = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out).view(np.int64)), batch.column("set_id").take(at), batch.column("n").take(at)],
                    names=["key", "set_id", "n"],
                )

    return suspects.select("set_id", "n", "shared").mapInArrow(keys, "key bigint, set_id bigint, n bigint")


def _pairs_within(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions with the same part, the lesser position first."""
    order = np.argsort(part, kind="stable")
    first, second = [], []
    for run in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        a, b = np.triu_indices(len(run), 1)
        first.append(run[a])
        second.append(run[b])
    return np.concatenate(first), np.concatenate(second)


def whole_sets(docs: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """The sets of ``wanted`` (``set_id`` and the ``row`` of one document that has
    it), read again from the texts: ``set_id``, ``hashes``."""
    wanted = written(wanted)
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.select("text", row_key().alias("row")).join(wanted, "row").select("set_id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                found = [shingle_set(t, words_each, memo) for t in batch.column("text").to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(f) for f in found])))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column("set_id"), lists], names=["set_id", "hashes"])

    return rows.mapInArrow(sets, "set_id bigint, hashes array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose sets are similar enough."""
    left = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("_a"))
    right = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    tested = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("_both", both)
    return tested.where(100 * F.col("_both") >= percent * (F.size("_a") + F.size("_b") - F.col("_both"))).select("a", "b")


class _Sets:
    """Sets of a table (``set_id``, ``label``, ``hashes``) as flat arrays."""

    def __init__(self, rows: pa.Table):
        self.ids, self.labels = rows.column("set_id").to_numpy(), rows.column("label").to_numpy()
        lists = rows.column("hashes").combine_chunks()
        self.ends, self.values = lists.offsets.to_numpy(), lists.values.to_numpy()
        self.sizes = np.diff(self.ends)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.ends[i] : self.ends[i + 1]]

    def gathered(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of some sets in one array, and the place in ``which`` of each one's set."""
        sizes = self.sizes[which]
        owner = np.repeat(np.arange(len(which)), sizes)
        return self.values[np.repeat(self.ends[which] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], owner


def _links_of(left: _Sets, out: np.ndarray, right: _Sets, all_: np.ndarray, percent: int, joined: dict[int, int]):
    """Links of the sets ``out`` of one block to the sets ``all_`` of another (or of
    the same), between labels that ``joined`` has not joined yet.

    Of a set most shingles must lie in some other set that it meets, or it has no
    link. What is left looks up as many of its rarest shingles as a partner can't
    lack all of, and is compared with the sets that hold one of them."""
    if not len(out) or not len(all_):
        return

    def root(label: int) -> int:
        while (above := joined.get(label, label)) != label:
            joined[label] = joined.get(above, above)
            label = above
        return label

    hashes, owner = right.gathered(all_)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    distinct, counts = hashes[starts], np.diff(np.append(starts, len(hashes)))
    needles, of = left.gathered(out)
    order = np.argsort(needles, kind="stable")  # in order they are found much faster
    at = np.empty(len(needles), np.int64)
    at[order] = np.minimum(np.searchsorted(distinct, needles[order]), len(distinct) - 1)
    often = np.where(distinct[at] == needles, counts[at], 0)
    itself = np.zeros(len(left.ids), bool)
    if left is right:
        itself[all_] = True
    met = np.bincount(of[often > itself[out][of]], minlength=len(out))
    ends = np.concatenate(([0], np.cumsum(left.sizes[out])))
    for k in np.flatnonzero(100 * met >= percent * left.sizes[out]):
        i, mine, found, held = out[k], left.of(out[k]), at[ends[k] : ends[k + 1]], often[ends[k] : ends[k + 1]]
        rare = np.argsort(held, kind="stable")[: lacking(len(mine), percent) + 1]
        near = np.unique(_postings(owner, starts[found[rare]], held[rare]))
        apart = right.labels[all_[near]] != left.labels[i]
        near = near[apart & (100 * right.sizes[all_[near]] >= percent * len(mine)) & (100 * len(mine) >= percent * right.sizes[all_[near]])]
        if not len(near):
            continue
        sizes = right.sizes[all_[near]]
        if held.sum() < sizes.sum():
            both = np.bincount(_postings(owner, starts[found], held), minlength=len(all_))[near]
        else:
            theirs, place = right.gathered(all_[near])
            same = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            both = np.bincount(place[same], minlength=len(near))
        reached = all_[near[100 * both >= percent * (len(mine) + sizes - both)]]
        _, first = np.unique(right.labels[reached], return_index=True)
        for j in reached[first]:
            a_label, b_label = root(int(left.labels[i])), root(int(right.labels[j]))
            if a_label != b_label:
                joined[a_label] = b_label
                yield int(left.ids[i]), int(right.ids[j])


def _postings(owner: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The owners in the runs that begin at ``starts``."""
    return owner[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]


def _block_links(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Links between different labels of two blocks (one with itself, if they are
    the same), each of which joins labels that those before it have not joined, so
    that blocks give fewer links than they have labels. Of two labels one is not
    the most frequent one, so the sets of all the others are looked up."""
    one = _Sets(left)
    two = one if left is right else _Sets(right)
    blocks = [one] if left is right else [one, two]
    labels, at = np.unique(np.concatenate([x.labels for x in blocks]), return_inverse=True)
    joined: dict[int, int] = {}
    found: list[tuple[int, int]] = []
    if len(labels) > 1:
        main = labels[np.bincount(at, np.concatenate([x.sizes for x in blocks])).argmax()]
        found += _links_of(one, np.flatnonzero(one.labels != main), two, np.arange(len(two.ids)), percent, joined)
        if two is not one:
            found += _links_of(two, np.flatnonzero(two.labels != main), one, np.flatnonzero(one.labels == main), percent, joined)
    return pa.table({
        "a": pa.array([min(f) for f in found], pa.int64()), "b": pa.array([max(f) for f in found], pa.int64())
    })


def _part_links(root: str, percent: int):
    """Links of pairs of parts (``family``, ``one``, ``two``, ``p``, ``q``: two size
    classes and a part of each), whose sets are read from the files at ``root``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)

        def part(family: int, size: int, number: int) -> pa.Table:
            return pq.read_table(f"{base}/family={family}/size={size}/part={number}", filesystem=files, columns=["set_id", "label", "hashes"])

        for batch in batches:
            for pair in batch.to_pylist():
                left = part(pair["family"], pair["one"], pair["p"])
                itself = (pair["one"], pair["p"]) == (pair["two"], pair["q"])
                right = left if itself else part(pair["family"], pair["two"], pair["q"])
                yield from _block_links(left, right, percent).to_batches()

    return check


def links_across(candidates: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All that still joins components: links between sets of one family with
    different labels. Candidates connect a family; what is linked already counts
    as one, so the graph of families is small.

    The sets of a large family are written once, in parts, and pairs of parts are
    read in tasks: no set is copied for each part it meets."""
    named = _labelled(_labelled(candidates.select("a", "b"), "a", labels, "la"), "b", labels, "lb")
    apart = named.where("la <> lb").select(*_ordered_pair("la", "lb")).distinct()
    family = components(apart).select(F.col("node").alias("label"), F.col("label").alias("family"))
    size_class_of = F.floor(F.log(F.size("hashes").cast("double")) / (math.log(100 / percent) * 1.0001))
    sized = sets.select("set_id", F.size("hashes").cast("bigint").alias("_size"), size_class_of.alias("size"))
    of_family = written(_labelled(sized, "set_id", labels, "label").join(family, "label"))
    # A small family meets whole. In larger ones similar sets are in the same
    # size class or in neighbouring ones, so each meets its own class and the next.
    fits = of_family.groupBy("family").agg((F.sum("_size") < WHOLE).alias("_fits"))
    # written, so that joins know how small it is beside the sets
    member = written(of_family.join(fits, "family"))
    whole = member.where("_fits").select("family", "set_id", "label").join(sets, "set_id")
    links = whole.groupBy("family").applyInArrow(lambda rows: _block_links(rows, rows, percent), "a bigint, b bigint")

    large = member.where("NOT _fits").drop("_fits")
    parts = large.groupBy("family", "size").agg(F.ceil(F.sum("_size") / BLOCK).alias("_parts"))
    part = F.expr("pmod(xxhash64(set_id), _parts)").alias("part")
    dealt = written(large.join(parts, ["family", "size"]).select("family", "size", part, "set_id", "label"))
    root = shared_path(sets.sparkSession)
    dealt.join(sets, "set_id").repartition("family", "size", "part").write.partitionBy("family", "size", "part").parquet(root)
    there = dealt.select("family", "size", "part").distinct()
    one = there.select("family", F.col("size").alias("one"), F.col("part").alias("p"))
    two = there.select("family", F.col("size").alias("two"), F.col("part").alias("q"))
    met = one.join(two, "family").where("two = one + 1 OR (two = one AND p <= q)")
    pairs = written(met.select("family", "one", "two", "p", "q"))
    # as many tasks as pairs, which are few and heavy
    tasks = pairs.repartition(max(1, min(pairs.count(), TASKS)))
    return links.unionByName(tasks.mapInArrow(_part_links(root, percent), "a bigint, b bigint")).distinct()


def _sizes_fit(a: str, b: str, percent: int) -> F.Column:
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _ordered_pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _labelled(df: DataFrame, node: str, labels: DataFrame, out: str) -> DataFrame:
    """``df`` with the label of a node; a node without links is its own label."""
    named = labels.select(F.col("node").alias(node), F.col("label").alias(out))
    return df.join(named, node, "left").withColumn(out, F.coalesce(out, node))


def similar_groups(docs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``,
    ``n_shingles``, ``component_id``, the smallest doc_id that links reach, and the
    ``row`` key.

    Two documents link if 100 times the size of the intersection of their sets
    is at least ``percent`` times that of the union. A text without words has an
    empty set and is its own component; so is its null doc_id. Repeated rows and
    rows with equal texts are in one component. Other columns are not read.
    Each stage is written at once (actions).
    """
    known = written(document_sets(docs, words_each, percent))
    tokens = known.where(F.size("prefix") > 0).select("set_id", F.explode("prefix").alias("h"))
    # copies of a set in several tasks may count as several; their keys meet no other set
    often = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(often, "h")
    by_set = shared.groupBy("set_id").agg(F.collect_set(F.struct("h", "df")).alias("shared"))
    sizes = known.where("n_shingles > 1").groupBy("set_id").agg(
        F.first("n_shingles").alias("n"), F.first("need").alias("need")
    )
    suspects = by_set.join(sizes, "set_id").where(F.size("shared") >= F.col("need"))
    keys = written(index_keys(suspects, percent))

    groups = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("_g"),
        F.min("set_id").alias("_centre"),
    ).where("_g > 1")
    grouped = written(keys.join(groups, "key"))
    small = grouped.where(F.col("_g") <= LARGE)
    one, two = small.select("key", F.col("set_id").alias("x"), F.col("n").alias("nx")), small.select("key", F.col("set_id").alias("y"), F.col("n").alias("ny"))  # noqa: E501
    within = one.join(two, "key").where("x < y").where(_sizes_fit("nx", "ny", percent)).select(*_ordered_pair("x", "y"))
    star = grouped.where(F.col("_g") > LARGE).select(F.col("set_id").alias("x"), F.col("_centre").alias("y"))
    candidates = written(
        within.union(star.where("x <> y").select(*_ordered_pair("x", "y"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys"))
    )

    # sets of all that have a candidate; each is read from one of its documents
    ends = candidates.select(F.col("a").alias("set_id")).union(candidates.select("b")).distinct()
    readable = known.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("row").alias("row"))
    sets = _once(written(whole_sets(docs, readable.join(ends, "set_id"), words_each)))

    # first each set with the two it shares most keys with
    both = candidates.select("a", "b", "keys", F.col("a").alias("v")).union(candidates.select("a", "b", "keys", F.col("b")))
    best = both.groupBy("v").agg(
        F.max(F.struct("keys", "a", "b")).alias("_1"), F.max(F.struct("keys", "b", "a")).alias("_2")
    )
    first = best.select(F.explode(F.array(F.struct("_1.a", "_1.b"), F.struct("_2.a", "_2.b"))).alias("p")).select("p.*").distinct()
    links = written(verified(first, sets, percent))
    labels = components(links)

    more = written(links_across(candidates.select("a", "b"), labels, sets, percent))
    labels = components(links.union(more))

    named = _labelled(known.select("doc_id", "row", "n_shingles", "set_id"), "set_id", labels, "_label")
    least = named.where("_label IS NOT NULL").groupBy("_label").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "_label", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "row"
    )


def _once(sets: DataFrame) -> DataFrame:
    """One row a set; rows that are repeated whole have given it several times."""
    repeated = not sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()
    return sets.dropDuplicates(["set_id"]) if repeated else sets


def without_similar(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest doc_id, with all
    its columns. Of a group without any doc_id all different rows stay."""
    groups = written(similar_groups(docs, words_each, percent))
    kept = groups.where("doc_id = component_id OR component_id IS NULL")
    return keep_rows(docs, kept.select("row"), groups.select("row"))


@query("op3_jaccard")
def jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return similar_groups(table(spark, folder, "documents"), 4, 85).drop("row")
