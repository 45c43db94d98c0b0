"""Filter specifications for many documents at once.

A specification with placeholders means other conditions for every document, and
a condition whose placeholder finds no value in a document drops out of that
document's conditions alone. Here conditions are rows, and records meet them in
joins: by value (``=``, ``in``) or by the pieces of a pattern (``like``). The
other operators decide about the records those have found.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertally.operators.candidates import like, pattern_hits
from papertally.operators.filters import PLACEHOLDER, Condition, DocumentValues, conditions, predicate, resolve
from papertally.session import written

_KEYED, _LIKE = ("=", "==", "in"), ("like", "not like")


@dataclass(frozen=True)
class Values:
    """What documents hold. ``fields``: (doc, key, idx, value, listed), where
    ``listed`` tells a key with a list from one with a single value; ``context``:
    (doc, key, value)."""

    fields: DataFrame
    context: DataFrame | None = None


def _templates(spec: Mapping | Sequence | None) -> tuple[list[Condition], list[tuple[int, str, str, str]]]:
    """Conditions that are the same for every document, and those with placeholders."""
    fixed, open_ = [], []
    for number, (field, op, value) in enumerate(conditions(spec)):
        if isinstance(value, str) and PLACEHOLDER.search(value):
            open_.append((number, field, str(op).lower(), value))
        else:
            fixed += resolve([[field, op, value]], DocumentValues())
    return fixed, open_


def _firsts(docs: DataFrame, values: Values, names: Sequence[str]) -> DataFrame:
    """``docs`` with a column for each placeholder: its first value, or empty."""
    out, asked = docs, {name: f"_v{i}" for i, name in enumerate(names)}
    own = {name: c for name, c in asked.items() if not name.startswith("context.")}
    if own:
        place = F.struct(F.coalesce("idx", F.lit(0)), F.col("value"))
        first = [F.min_by("value", F.when(F.col("key") == name, place)).alias(c) for name, c in own.items()]
        out = out.join(values.fields.where(F.col("key").isin(list(own))).groupBy("doc").agg(*first), "doc", "left")
    rest = {name.removeprefix("context."): c for name, c in asked.items() if name not in own}
    if rest and values.context is not None:
        found = [F.min(F.when(F.col("key") == name, F.col("value"))).alias(c) for name, c in rest.items()]
        out = out.join(values.context.where(F.col("key").isin(list(rest))).groupBy("doc").agg(*found), "doc", "left")
    return out


def document_conditions(
    docs: DataFrame, values: Values, filters: Mapping | Sequence | None, or_filters: Mapping | Sequence | None
) -> DataFrame:
    """(doc, part, cond, field, op, value): what each document asks for, one row
    per condition and alternative; ``part`` is ``all`` or ``any``. Conditions
    without a placeholder, alike for all documents, are not among them.

    ``in`` and ``not in`` with a bare placeholder take every value of the
    document; so does ``like`` with a list, as one condition each. A condition
    left without a value, and a pattern of wildcards only, have no row.
    """
    branches = []
    for part, spec in (("all", filters), ("any", or_filters)):
        for number, field, op, template in _templates(spec)[1]:
            names = list(dict.fromkeys(PLACEHOLDER.findall(template)))
            own = [n for n in names if not n.startswith("context.")]
            label = lambda rows, cond, value: rows.select(
                "doc", F.lit(part).alias("part"), cond.alias("cond"), F.lit(field).alias("field"), F.lit(op).alias("op"), value.alias("value")  # noqa: B023
            )
            whole = F.lit(f"{part}{number}")
            if op in ("in", "not in") and own and template == "{" + own[0] + "}":
                held = values.fields.where((F.col("key") == own[0]) & (F.col("value") != "")).select("doc", "value").distinct()
                branches.append(label(held.join(docs, "doc", "left_semi"), whole, F.col("value")))
                continue
            wide = _firsts(docs, values, names)
            filled = lambda skip=None: functools.reduce(
                lambda text, item: F.replace(text, F.lit("{" + item[1] + "}"), F.coalesce(F.col(f"_v{item[0]}"), F.lit("")) if f"_v{item[0]}" in wide.columns else F.lit("")),  # noqa: B023, E501
                [(i, n) for i, n in enumerate(names) if n != skip],  # noqa: B023
                F.lit(template),  # noqa: B023
            )
            single = wide
            if op in _LIKE and own:
                # documents whose key is a list ask once for each of its values
                for name in own:
                    lists = values.fields.where((F.col("key") == name) & F.col("listed"))
                    each = lists.where(F.col("value") != "").select("doc", F.col("value").alias("_each")).distinct()
                    pattern = F.replace(filled(name), F.lit("{" + name + "}"), F.col("_each"))
                    branches.append(
                        label(single.join(each, "doc").withColumn("_p", pattern).where("_p <> ''"), F.concat(whole, F.lit(":"), F.col("_p")), F.col("_p"))
                    )
                    single = single.join(lists.select("doc").distinct(), "doc", "left_anti")
            made = single.withColumn("_p", filled())
            kept = F.btrim(F.col("_p"), F.lit("%_ ")) != "" if op in _LIKE else F.col("_p") != ""
            branches.append(label(made.where(kept), whole, F.col("_p")))
    none = docs.limit(0).select("doc", *[F.lit("").alias(c) for c in ("part", "cond", "field", "op", "value")])
    return functools.reduce(DataFrame.unionByName, branches, none)


def _fits(op: Column, text: Column, value: Column) -> Column:
    """Does a record's text fit one alternative of a condition?"""
    a, b = text.try_cast("double"), value.try_cast("double")
    both = a.isNotNull() & b.isNotNull()
    less = F.when(both, a < b).otherwise(text < value)
    same = F.when(both, a == b).otherwise(text == value)
    return (
        F.when(op.isin(*_KEYED), text == value)
        .when(op == "not in", text != value)
        .when(op.isin("!=", "<>"), ~same)
        .when(op == "like", like(text, value))
        .when(op == "not like", ~like(text, value))
        .when(op == "<", less).when(op == "<=", less | same)
        .when(op == ">", ~less & ~same).when(op == ">=", ~less)
        .otherwise(same)
    )


@dataclass(frozen=True)
class Fetched:
    """``rows``: (doc, key) of each document's records. ``documents``: (doc,
    n_conditions, guarded): how many conditions of its own it kept, and whether
    the guard held it back."""

    rows: DataFrame
    documents: DataFrame


def fetch_by_document(
    docs: DataFrame,
    values: Values,
    target: DataFrame,
    key: str,
    filters: Mapping | Sequence | None = None,
    or_filters: Mapping | Sequence | None = None,
) -> Fetched:
    """The records that each document of ``docs`` (doc) asks for.

    All conditions of ``filters`` hold and, where ``or_filters`` are declared,
    one of theirs. The guard: a document whose declared ``or_filters`` all
    dropped fetches nothing, nor does one that is left without a condition of
    its own, or only with such as need a scan of the whole table (``!=``, ``<``,
    ``not in`` and their like, or alternatives of which one is fixed):
    ``guarded`` tells. Values are compared as text;
    an ordering compares numbers where both are such. A null field of a record
    fits no condition. ``key`` is unique in ``target``.
    """
    fixed_all, open_all = _templates(filters)
    fixed_any, open_any = _templates(or_filters)
    rule = predicate(fixed_all, [])
    pool = target if rule is None else target.where(rule)
    asked = written(document_conditions(docs.select("doc").distinct(), values, filters, or_filters))
    templates = [*open_all, *open_any]
    meets = _meetings(asked, pool, key, templates)
    drivers, state = _drivers(docs, asked, meets, needs_any=bool(conditions(or_filters)), any_fixed=bool(fixed_any))
    pairs = drivers.join(meets, ["field", "op", "value"]).select("doc", "key").distinct()
    fields = sorted({field for _, field, _, _ in templates})
    free = F.lit(True)
    if conditions(or_filters):
        free = predicate([], fixed_any) if fixed_any else F.lit(False)
    texts = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])
    records = pool.select(F.col(key).alias("key"), texts.alias("texts"), F.coalesce(free, F.lit(False)).alias("free"))
    tested = pairs.join(asked, "doc").join(records, "key")
    fit = F.coalesce(_fits(F.col("op"), F.element_at("texts", F.col("field")), F.col("value")), F.lit(False))
    each = tested.select("doc", "key", "part", "cond", "free", F.col("op").isin("not in", "not like").alias("no"), fit.alias("fit"))
    by_condition = each.groupBy("doc", "key", "part", "cond", "free", "no").agg(F.bool_and("fit").alias("every"), F.bool_or("fit").alias("some"))
    good = F.when(F.col("no"), F.col("every")).otherwise(F.col("some"))
    of_all = F.col("part") == "all"
    rows = by_condition.groupBy("doc", "key").agg(
        F.bool_and(~of_all | good).alias("all"), F.bool_or(F.col("free") | (~of_all & good)).alias("any")
    ).where(F.col("all") & F.col("any"))
    return Fetched(rows.select("doc", "key"), state)


def _meetings(asked: DataFrame, pool: DataFrame, key: str, templates: Sequence[tuple]) -> DataFrame:
    """(field, op, value, key): the records of every distinct value and pattern."""
    distinct = asked.select("field", "op", "value").distinct()
    met = []
    for field in sorted({f for _, f, _, _ in templates}):
        wants = distinct.where(F.col("field") == field)
        ops = {op for _, f, op, _ in templates if f == field}
        if ops & set(_KEYED):
            same = wants.where(F.col("op").isin(*_KEYED))
            own = pool.select(F.col(key).alias("key"), F.col(field).cast("string").alias("text"))
            met.append(same.join(own, same["value"] == own["text"]).select("field", "op", "value", "key"))
        if "like" in ops:
            likes = wants.where(F.col("op") == "like")
            hits = pattern_hits(likes.select(F.col("value").alias("pattern")), pool, field, key).withColumnRenamed(key, "key")
            met.append(likes.join(hits, likes["value"] == hits["pattern"]).select("field", "op", "value", "key"))
    if not met:
        return distinct.limit(0).withColumn("key", F.lit(None).cast(pool.schema[key].dataType))
    return written(functools.reduce(DataFrame.unionByName, met))


def _drivers(docs: DataFrame, asked: DataFrame, meets: DataFrame, needs_any: bool, any_fixed: bool) -> tuple[DataFrame, DataFrame]:
    """The conditions (doc, field, op, value) through which each document finds
    its records, and (doc, n_conditions, guarded) of every document.

    One condition of ``all`` will do, or all those of ``any`` together, if joins
    can find their records; a document takes what fewest records meet, and the
    rest of its conditions only decide."""
    held = meets.groupBy("field", "op", "value").agg(F.count(F.lit(1)).alias("n"))
    keyed = F.col("op").isin(*_KEYED, "like")
    of_any = F.col("part") == "any"
    costs = asked.join(held, ["field", "op", "value"], "left").select(
        "doc", F.when(of_any, "any").otherwise(F.col("cond")).alias("way"), "cond", (~keyed).cast("int").alias("open"), F.coalesce("n", F.lit(0)).alias("n")
    )
    ways = costs.groupBy("doc", "way").agg(F.max("open").alias("open"), F.sum("n").alias("n"), F.count_distinct("cond").alias("conds"))
    usable = (F.col("open") == 0) & ~((F.col("way") == "any") & F.lit(any_fixed))
    chosen = ways.groupBy("doc").agg(
        F.min_by("way", F.when(usable, F.struct("n", "way"))).alias("way"),
        F.sum("conds").alias("n_conditions"),
        F.max(F.when(F.col("way") == "any", 1).otherwise(0)).alias("has_any"),
    )
    lacks_any = (F.col("has_any") == 0) & F.lit(needs_any and not any_fixed)
    state = docs.select("doc").distinct().join(chosen, "doc", "left").fillna(0, ["n_conditions", "has_any"])
    state = written(state.select("doc", "n_conditions", "way", (lacks_any | F.col("way").isNull()).alias("guarded")))
    led = state.where(~F.col("guarded")).select("doc", F.col("way").alias("_way"))
    drivers = asked.join(led, "doc").where(F.when(of_any, "any").otherwise(F.col("cond")) == F.col("_way"))
    return drivers.select("doc", "field", "op", "value"), state.select("doc", "n_conditions", "guarded")
