"""Candidate records for many documents at once.

``refs``    (doc, kind, value, pos): the reference values found in each document.
``target``  the business records, with a ``name`` column.

Everything is an equi-join: by value, by trailing number, or by a three-letter
piece of the searched text.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertally.config import let
from papertally.functions.dates import within_text_bounds
from papertally.functions.positions import keep_first, top_rows
from papertally.functions.text import blank_to_null, trailing_digits
from papertally.operators.filters import DocumentValues, predicate, resolve
from papertally.session import written


def reference_values(items: DataFrame) -> DataFrame:
    """Distinct non-empty values per (doc, key), at their first position.

    ``items``: (doc, key, idx, value). Gives (doc, kind, value, pos).
    """
    return (
        items.where(F.col("value") != "")
        .groupBy("doc", F.col("key").alias("kind"), "value")
        .agg(F.min(F.coalesce("idx", F.lit(0))).alias("pos"))
    )


def richest_kind(refs: DataFrame) -> DataFrame:
    """(doc, expected): number of values of the kind that has most of them."""
    per_kind = refs.groupBy("doc", "kind").agg(F.count(F.lit(1)).alias("n"))
    return per_kind.groupBy("doc").agg(F.max("n").alias("expected"))


def exact_join(refs: DataFrame, target: DataFrame, field: str) -> DataFrame:
    """Records whose field equals a reference value, compared as text."""
    keyed = target.withColumn("_key", blank_to_null(F.col(field).cast("string")))
    return refs.join(keyed, refs["value"] == keyed["_key"]).drop("_key")


def suffix_join(refs: DataFrame, target: DataFrame, field: str) -> DataFrame:
    """Records whose trailing number equals that of a reference value."""
    left = refs.withColumn("_tail", trailing_digits(F.col("value")))
    right = target.withColumn("_key_tail", trailing_digits(F.col(field).cast("string")))
    return left.join(right, left["_tail"] == right["_key_tail"]).drop("_tail", "_key_tail")


def in_list(target: DataFrame, refs: DataFrame, field: str, negate: bool = False) -> DataFrame:
    """Records whose field is (not) among the values; each record once."""
    values = refs.select(F.col("value").alias("_value")).distinct()
    how = "left_anti" if negate else "left_semi"
    return target.join(values, target[field].cast("string") == values["_value"], how)


# Lengths of pieces: a stretch of letters is looked up by the longest that it holds.
_SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)


def _pieces(letters: Column, size: int) -> Column:
    """Every run of ``size`` letters, put together from shorter ones; those that
    run over the end are null."""

    def beside(a: Column, b: Column, shift: int) -> Column:
        return F.zip_with(a, F.slice(b, F.lit(shift + 1), F.greatest(F.size(b), F.lit(1))), lambda x, y: F.concat(x, y))

    if size == 1:
        return letters
    if size == 3:
        return let(letters, lambda one: beside(beside(one, one, 1), one, 2))
    return let(_pieces(letters, size // 2), lambda half: beside(half, half, size // 2))


def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """The distinct pieces of a text that have one of these lengths."""
    found = let(F.split(text, ""), lambda letters: F.flatten(F.array(*[_pieces(letters, s) for s in sizes])))
    return F.array_distinct(F.filter(found, lambda g: g.isNotNull() & (g != "")))


def _core(pattern: Column) -> Column:
    """The longest stretch of a LIKE pattern without wildcards (the first of equals)."""
    stretches = F.array_sort(F.split(pattern, "[%_]"), lambda a, b: F.length(b) - F.length(a))
    return F.get(stretches, F.lit(0))


def like(text: Column, pattern: Column) -> Column:
    """LIKE in which a backslash is a letter."""
    return F.like(text, F.replace(pattern, F.lit("\\"), F.lit("\\\\")))


def pattern_hits(patterns: DataFrame, target: DataFrame, field: str, key: str = "name") -> DataFrame:
    """(pattern, key): the records whose field is LIKE each distinct ``pattern``.

    A text that fits a pattern holds every piece of the pattern's longest stretch
    of letters. An index of pieces, which has keys but no texts, is written once;
    each pattern looks up the one of its pieces that fewest records hold, and the
    texts meet what is left. Pieces are as long as the stretch allows (``_SIZES``):
    a long number has a piece few records hold, however many there are. A pattern
    without a letter fits nothing here. Three tables are written (actions): the
    patterns, the index and the chosen pieces; the lengths asked for, twelve at
    most, are read.
    """
    core = patterns.select("pattern").distinct().withColumn("core", _core(F.col("pattern"))).where(F.length("core") > 0)
    fits = F.filter(F.array(*[F.lit(s) for s in _SIZES]), lambda s: s <= F.length("core"))
    core = written(core.withColumn("size", F.array_max(fits)))
    sizes = sorted(r["size"] for r in core.select("size").distinct().collect()) or [1]
    of_size = F.lit(None).cast("array<string>")
    for s in sizes:
        of_size = F.when(F.col("size") == s, _grams(F.col("core"), [s])).otherwise(of_size)
    pieces = core.select("pattern", F.explode(of_size).alias("piece"))
    hay = target.select(F.col(key).alias("_key"), F.explode(_grams(F.col(field).cast("string"), sizes)).alias("piece"))
    # only pieces some pattern asks for are counted and kept
    index = written(hay.join(pieces.select("piece").distinct(), "piece", "left_semi"))
    held = index.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    # a pattern with a piece that no record has fits none, so an inner join of its rarest will do
    rarest = pieces.join(held, "piece", "left").groupBy("pattern").agg(
        F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece")
    )
    pairs = written(rarest).join(index, "piece").select("pattern", "_key")
    texts = target.select(F.col(key).alias("_own"), F.col(field).cast("string").alias("_text"))
    met = pairs.join(texts, F.col("_key") == F.col("_own")).where(like(F.col("_text"), F.col("pattern")))
    return met.select("pattern", F.col("_key").alias(key))


def contains_join(refs: DataFrame, target: DataFrame, field: str, key: str = "name") -> DataFrame:
    """Records whose field holds a reference value (``LIKE '%value%'``), by
    :func:`pattern_hits`. ``key`` is unique in ``target``.

    ``%`` and ``_`` inside a value keep their meaning; a value made only of
    them selects nothing.
    """
    pattern = F.concat(F.lit("%"), F.col("value"), F.lit("%"))
    asked = refs.withColumn("_pattern", pattern)
    hits = pattern_hits(asked.select(F.col("_pattern").alias("pattern")), target, field, key)
    found = hits.select(F.col("pattern").alias("_pattern"), F.col(key).alias("_hit"))
    joined = asked.join(found, "_pattern").drop("_pattern")
    return joined.join(target, joined["_hit"] == target[key]).drop("_hit")


def eligible(record_date: Column, context_from: Column, context_to: Column) -> Column:
    """The record's date lies in the document's window (compared as text)."""
    return within_text_bounds(record_date, context_from, context_to)


def union_first(queries: Sequence[DataFrame], keys: Sequence[str] = ("doc", "name")) -> DataFrame:
    """Union of query results; each record is kept where it came first.

    Each input has ``fetch_pos`` (its order inside the query); the result has
    ``query_ord`` and ``fetch_pos`` of the kept row.
    """
    tagged = [q.withColumn("query_ord", F.lit(i)) for i, q in enumerate(queries)]
    every = functools.reduce(lambda a, b: a.unionByName(b), tagged)
    rest = [c for c in every.columns if c not in (*keys, "query_ord", "fetch_pos")]
    return keep_first(every, keys, F.struct("query_ord", "fetch_pos", *rest))


def cap_per_document(cands: DataFrame, cap: int | None) -> DataFrame:
    """The first ``cap`` candidates per document in fetch order; ``None`` = all."""
    if cap is None:
        return cands
    order = [F.col("query_ord"), F.col("fetch_pos"), F.col("name")]
    return top_rows(cands, ["doc"], order, cap, "_n").drop("_n")


# The fetch limits of one query and of one document.
QUERY_LIMIT = 40
DOCUMENT_LIMIT = 60


# What the records of an equi-joined key have in common.
_KEY_OF = {"exact": blank_to_null, "suffix": trailing_digits}


def fetch_candidates(
    refs: DataFrame,
    target: DataFrame,
    queries: Sequence[Mapping[str, Any]],
    query_cap: int | None = None,
    document_cap: int | None = None,
) -> DataFrame:
    """Candidates of all documents in one plan: (doc, name, <fields>, order).

    A query is ``{"keys": [{"field", "from", "match"}], "filters": {...},
    "order": expression}`` (compared as text) with match ``exact``, ``suffix`` or ``contains``. Its
    keys are alternatives; a document without any of the values fetches
    nothing, so no query can run over the whole table by accident. Caps are the
    reference limits (``QUERY_LIMIT``, ``DOCUMENT_LIMIT``) when asked for;
    without them the result is whole.

    A document's first ``query_cap`` records are among the first ``query_cap``
    of each of its values, so with a cap an equi-joined target is cut per key
    before the join: a trailing number shared by a large part of the records
    does not multiply them.
    """
    if query_cap is None and document_cap is None and any(k.get("match") == "contains" for q in queries for k in q["keys"]):
        return _fetch_by_lists(refs, target, queries)
    return cap_per_document(union_first([_fetched(refs, target, query, query_cap) for query in queries]), document_cap)


def _fetched(refs: DataFrame, target: DataFrame, query: Mapping[str, Any], query_cap: int | None = None) -> DataFrame:
    """The records one query finds: (doc, <fields>, fetch_pos), each once a document."""
    join_of = {"exact": exact_join, "suffix": suffix_join, "contains": contains_join}
    condition = predicate(resolve(query.get("filters"), DocumentValues()), [])
    rows = target if condition is None else target.where(condition)
    order = F.expr(query.get("order", "name")).cast("string")
    branches = []
    for spec in query["keys"]:
        side = refs.where(F.col("kind") == spec["from"]).select("doc", "value")
        mode = spec.get("match", "exact")
        near = rows
        if query_cap is not None and mode in _KEY_OF:
            key = _KEY_OF[mode](F.col(spec["field"]).cast("string"))
            keyed = rows.withColumn("_cut_key", key).where(F.col("_cut_key").isNotNull())
            near = top_rows(keyed, ["_cut_key"], [order, F.col("name")], query_cap, "_n").drop("_cut_key", "_n")
        found = join_of[mode](side, near, spec["field"])
        branches.append(found.drop("value"))
    hits = functools.reduce(lambda a, b: a.unionByName(b), branches).dropDuplicates(["doc", "name"])
    hits = hits.withColumn("fetch_pos", order)
    if query_cap is None:
        return hits
    return top_rows(hits, ["doc"], [F.col("fetch_pos"), F.col("name")], query_cap, "_n").drop("_n")


# References of a document up to which it is dealt with by lists, and records up
# to which those an earlier query found are dropped from a later list in place.
LIST_LIMIT = 64
SKIP_LIMIT = 100


def _fetch_by_lists(refs: DataFrame, target: DataFrame, queries: Sequence[Mapping[str, Any]]) -> DataFrame:
    """:func:`fetch_candidates` without caps, the records of a query fetched once
    for all documents that ask it for the same values.

    A text held by many records and asked for by many documents gives rows by
    their product. So rows are made distinct in the list of records that a set of
    values finds; a document's rows are read off its lists in the last join and
    are not shuffled. What an earlier query of the document found (the records
    two of its lists share) is left out there. Documents with more than
    ``LIST_LIMIT`` references, null ones among them, go row by row, as do
    those that share more than ``SKIP_LIMIT`` records. Tables of references, lists
    and documents are written (actions); the rows are not.
    """
    sides = [
        refs.where(F.col("kind").isin([k["from"] for k in query["keys"]]) & F.col("value").isNotNull()).select(
            "doc", F.lit(q).alias("_q"), "kind", "value"
        )
        for q, query in enumerate(queries)
    ]
    asked = written(functools.reduce(lambda a, b: a.unionByName(b), sides))
    many = written(asked.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIST_LIMIT).select(F.col("doc").alias("_many")))
    few = asked.join(many, F.col("doc").eqNullSafe(F.col("_many")), "left_anti")
    values = F.struct("kind", "value")
    dealt = written(
        few.groupBy("doc").agg(*[F.sort_array(F.collect_set(F.when(F.col("_q") == q, values))).alias(f"_list{q}") for q in range(len(queries))])
    )
    columns = ["doc", *target.columns, "fetch_pos", "query_ord"]
    lists, parts = [], []
    for q, query in enumerate(queries):
        mine = f"_list{q}"
        distinct = dealt.where(F.size(mine) > 0).select(F.col(mine).alias("doc")).distinct()
        own = written(_fetched(distinct.select("doc", F.inline("doc")), target, query).withColumnRenamed("doc", mine))
        docs = dealt.where(F.size(mine) > 0).select("doc", mine)
        if lists:
            shared = functools.reduce(lambda a, b: a.unionByName(b), [_shared(dealt, p, theirs, q, own) for p, theirs in enumerate(lists)])
            skip = shared.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set(F.struct("name")).alias("_skip"))
            # documents of a list stand together, so that the rows they give, written, shrink to a few bits
            docs = written(docs.join(skip, F.col("doc").eqNullSafe(F.col("_doc")), "left").drop("_doc").sortWithinPartitions(mine))
            few_shared = F.col("_skip").isNull() | (F.size("_skip") <= SKIP_LIMIT)
            near = docs.where(few_shared).join(own, mine)
            parts.append(
                near.where(F.col("_skip").isNull() | ~F.array_contains("_skip", F.struct("name"))).withColumn("query_ord", F.lit(q)).select(*columns)
            )
            far = docs.where(~few_shared)
            taken = far.select(F.col("doc").alias("_doc"), F.explode("_skip").alias("_s"))
            same = F.col("doc").eqNullSafe(F.col("_doc")) & F.col("name").eqNullSafe(F.col("_s.name"))
            parts.append(far.drop("_skip").join(own, mine).join(taken, same, "left_anti").withColumn("query_ord", F.lit(q)).select(*columns))
        else:
            parts.append(docs.join(own, mine).withColumn("query_ord", F.lit(q)).select(*columns))
        lists.append(own)
    if not many.isEmpty():
        rest = refs.join(many, F.col("doc").eqNullSafe(F.col("_many")), "left_semi")
        parts.append(union_first([_fetched(rest, target, query) for query in queries]).select(*columns))
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def _shared(dealt: DataFrame, p: int, theirs: DataFrame, q: int, own: DataFrame) -> DataFrame:
    """(doc, name): records that both the ``p``-th and the ``q``-th list of a
    document hold, met once for documents with the same two lists."""
    first, second = f"_list{p}", f"_list{q}"
    both = dealt.where((F.size(first) > 0) & (F.size(second) > 0)).select("doc", first, second)
    pairs = both.select(first, second).distinct().join(theirs.select(first, "name"), first)
    known = own.select(F.col(second).alias("_own"), F.col("name").alias("_name"))
    met = pairs.join(known, (F.col(second) == F.col("_own")) & F.col("name").eqNullSafe(F.col("_name")), "left_semi")
    return both.join(met, [first, second]).select("doc", "name")


def find_matches(refs: DataFrame, target: DataFrame, queries: Sequence[Mapping[str, Any]]) -> DataFrame:
    """(doc, kind, value, pos, name, key_ord, query_ord, fetch_pos): every record
    a key of a query finds, with the reference that led to it; ``key_ord`` counts
    the keys of all queries. Queries are those of :func:`fetch_candidates`, whole.

    Of the records only name, key and order take part, so that what later steps
    read again and again is narrow; :func:`with_fields` adds the rest.
    """
    join_of = {"exact": exact_join, "suffix": suffix_join, "contains": contains_join}
    found, key_ord = [], 0
    for query_ord, query in enumerate(queries):
        condition = predicate(resolve(query.get("filters"), DocumentValues()), [])
        rows = target if condition is None else target.where(condition)
        order = F.expr(query.get("order", "name")).cast("string").alias("fetch_pos")
        for spec in query["keys"]:
            side = refs.where(F.col("kind") == spec["from"]).select("doc", "kind", "value", "pos")
            near = rows.select("name", F.col(spec["field"]).cast("string").alias("_field"), order)
            hits = join_of[spec.get("match", "exact")](side, near, "_field")
            found.append(hits.drop("_field").withColumns({"key_ord": F.lit(key_ord), "query_ord": F.lit(query_ord)}))
            key_ord += 1
    return functools.reduce(lambda a, b: a.unionByName(b), found)


def with_fields(matches: DataFrame, target: DataFrame) -> DataFrame:
    """The candidates of :func:`fetch_candidates` from its matches: each record of
    a document once, where it came first, with its fields. ``name`` is unique in
    ``target``."""
    first = matches.groupBy("doc", "name").agg(F.min(F.struct("query_ord", "fetch_pos")).alias("_first"))
    kept = first.select("doc", "name", "_first.query_ord", "_first.fetch_pos")
    return kept.join(target, "name").select("doc", *target.columns, "query_ord", "fetch_pos")


def contains_every(refs: DataFrame, target: DataFrame, field: str, key: str = "name") -> DataFrame:
    """Records whose field holds all the values of a document.

    This is the meaning of an expanded LIKE inside ``filters``: (doc, key).
    """
    wanted = refs.select("doc", "value").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("_wanted"))
    hits = contains_join(refs.select("doc", "value").distinct(), target.select(key, field), field, key)
    return (
        hits.groupBy("doc", key)
        .agg(F.count_distinct("value").alias("_n"))
        .join(wanted, "doc")
        .where(F.col("_n") == F.col("_wanted"))
        .select("doc", key)
    )
