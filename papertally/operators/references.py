"""Do the references of a document agree?

Every reference value is resolved on its own against the document's candidate
records; then the resolutions are tested together. A document whose references
claim more records than its richest kind of reference has values contradicts
itself.

Only counts and single names travel through the aggregates, never lists of
names, so a value that matches a large part of the records stays cheap.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertally.config import literal_map
from papertally.functions.text import blank_to_null, trailing_digits


@dataclass(frozen=True)
class Rule:
    """One corroboration rule: a record field against a kind of reference."""

    target_field: str
    source: str
    match: str = "exact"
    label: str | None = None
    score: float | None = None

    @property
    def mode(self) -> str:
        return "suffix" if self.match == "numeric_suffix" else "exact"

    @staticmethod
    def parse(raw: Mapping) -> Rule | None:
        """A rule without a field or a source is ignored."""
        if not raw.get("target_field") or not raw.get("from"):
            return None
        return Rule(
            raw["target_field"],
            raw["from"],
            raw.get("match") or "exact",
            raw.get("label"),
            float(raw["score"]) if raw.get("score") else None,
        )


def rules_of(raw_rules: Sequence[Mapping]) -> list[Rule]:
    return [rule for rule in map(Rule.parse, raw_rules) if rule]


def _kind_order(rules: Sequence[Rule]) -> dict[str, int]:
    return {kind: i for i, kind in enumerate(dict.fromkeys(r.source for r in rules))}


def _labels(rules: Sequence[Rule]) -> dict[str, str]:
    labels: dict[str, str] = {}
    for rule in rules:
        if rule.label:
            labels.setdefault(rule.source, rule.label)
    return {kind: labels.get(kind, kind) for kind in _kind_order(rules)}


def _lookup(mapping: Mapping[str, object], key: Column) -> Column:
    return F.element_at(literal_map(mapping), key)


def match_key_of(value: Column, mode: Column) -> Column:
    """What is compared: the text itself, or its trailing number."""
    return F.when(mode == "exact", blank_to_null(value)).otherwise(trailing_digits(value))


def keyed_candidates(cands: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc, name, kind, mode, key, rule_ord): one row per rule that has a
    key in the record, made by one narrow explode."""
    entries = F.array(
        *[
            F.struct(
                F.lit(r.source).alias("kind"),
                F.lit(r.mode).alias("mode"),
                F.lit(i).alias("rule_ord"),
                F.col(r.target_field).cast("string").alias("text"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return (
        cands.select("doc", "name", F.inline(entries))
        .withColumn("key", match_key_of(F.col("text"), F.col("mode")))
        .where(F.col("key").isNotNull())
        .drop("text")
    )


def reference_hits(refs: DataFrame, cands: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc, kind, value, pos, mode, name, rule_ord): every reference with
    every record it matches, by one equi-join on (doc, kind, mode, key).

    A reference without any match keeps one row without ``name``. The other
    functions of this module and of ``matching`` all work on this table; write
    it once (:func:`papertally.session.written`) when several of them are used.
    """
    modes: dict[str, list[str]] = {}
    for r in rules:
        if r.mode not in modes.setdefault(r.source, []):
            modes[r.source].append(r.mode)
    asked = F.element_at(
        F.create_map(*[x for k, ms in modes.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in ms]))]), F.col("kind")
    )
    left = (
        refs.where(F.col("kind").isin(list(modes)))
        .withColumn("mode", F.explode(asked))
        .withColumn("key", match_key_of(F.col("value"), F.col("mode")))
    )
    return left.join(keyed_candidates(cands, rules), ["doc", "kind", "mode", "key"], "left").drop("key")


def covered_rules(rules: Sequence[Rule], queries: Sequence[Mapping]) -> dict[int, int]:
    """Rules, by place, that say what a key of a whole, unfiltered query says, with
    that key's number: all records they can match are among what it finds."""
    keys: dict[tuple, int] = {}
    number = 0
    for query in queries:
        for spec in query["keys"]:
            if not query.get("filters"):
                keys.setdefault((spec["field"], spec["from"], spec.get("match", "exact")), number)
            number += 1
    said = {i: keys.get((r.target_field, r.source, r.mode)) for i, r in enumerate(rules)}
    return {i: number for i, number in said.items() if number is not None}


def hits_of_matches(refs: DataFrame, matches: DataFrame, cands: DataFrame, rules: Sequence[Rule], queries: Sequence[Mapping]) -> DataFrame:
    """The table of :func:`reference_hits`, of which rows without a name may stand
    beside rows with one. What the fetch has already met
    (:func:`papertally.operators.candidates.find_matches`) is not joined again;
    only rules that no key of a query covers are."""
    covered = covered_rules(rules, queries)
    sources = list(dict.fromkeys(r.source for r in rules))
    names = ["doc", "kind", "value", "pos", "mode", "name", "rule_ord"]
    bare = refs.where(F.col("kind").isin(sources)).select(
        "doc", "kind", "value", "pos", F.lit(None).cast("string").alias("mode"),
        F.lit(None).cast(matches.schema["name"].dataType).alias("name"), F.lit(None).cast("int").alias("rule_ord"),
    )
    out = bare
    if covered:
        by_key = F.array(*[
            F.struct(F.lit(key).alias("key"), F.lit(rules[i].mode).alias("mode"), F.lit(i).alias("rule_ord"))
            for i, key in covered.items()
        ])
        fit = F.filter(by_key, lambda x: x["key"] == F.col("key_ord"))
        met = matches.select("doc", "kind", "value", "pos", "name", F.inline(fit)).drop("key")
        out = out.unionByName(met.select(*names))
    rest = [(i, r) for i, r in enumerate(rules) if i not in covered]
    if rest:
        places = F.array(*[F.lit(i) for i, _ in rest])
        more = reference_hits(refs, cands, [r for _, r in rest]).where(F.col("name").isNotNull())
        out = out.unionByName(more.withColumn("rule_ord", F.get(places, F.col("rule_ord"))).select(*names))
    return out


def resolve_references(hits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc, kind, value, pos, kind_ord, n_exact, n_suffix, target, strength,
    via, status): one row per reference value, from :func:`reference_hits`.

    A value with exactly one exact record is proven; with several it is a
    ``duplicate``. Others fall back on trailing numbers: ``paired`` with a
    proven record, else a lone ``suffix`` record, else ``ambiguous``.
    """
    kinds = _kind_order(rules)
    keys = ["doc", "kind", "value"]
    names = hits
    if len({(r.source, r.mode) for r in rules}) < len(rules):
        # a record may match by several fields of one mode: the first field counts
        names = hits.groupBy(*keys, "mode", "name").agg(
            F.min("rule_ord").alias("rule_ord"), F.min("pos").alias("pos")
        )
    proven = (
        names.where((F.col("mode") == "exact") & F.col("name").isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
        .where(F.col("n") == 1)
        .select("doc", "name")
        .distinct()
    )
    record = F.when(F.col("name").isNotNull(), F.struct("name", "rule_ord"))
    exact, suffix = F.col("mode") == "exact", F.col("mode") == "suffix"
    # only records found by their trailing number meet the proven ones
    by_number = names.where(suffix & F.col("name").isNotNull()).select(*keys, "name", "rule_ord")
    paired = by_number.join(proven, ["doc", "name"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_paired"), F.min(F.struct("name", "rule_ord")).alias("_paired")
    )
    found = names.groupBy(*keys).agg(
        F.min("pos").alias("pos"),
        F.count(F.when(exact, F.col("name"))).alias("n_exact"),
        F.count(F.when(suffix, F.col("name"))).alias("n_suffix"),
        F.min(F.when(exact, record)).alias("_exact"),
        F.min(F.when(suffix, record)).alias("_suffix"),
    )
    counted = found.join(paired, keys, "left")
    status = (
        F.when(F.col("n_exact") == 1, "exact")
        .when(F.col("n_exact") > 1, "duplicate")
        .when(F.col("n_paired") == 1, "paired")
        .when(F.col("n_suffix") == 1, "suffix")
        .when(F.col("n_suffix") > 1, "ambiguous")
        .otherwise("unresolved")
    )
    chosen = (
        F.when(F.col("status") == "exact", F.col("_exact"))
        .when(F.col("status") == "paired", F.col("_paired"))
        .when(F.col("status") == "suffix", F.col("_suffix"))
    )
    return (
        counted.withColumn("status", status)
        .withColumn("_chosen", chosen)
        .select(
            *keys,
            "pos",
            _lookup(kinds, F.col("kind")).alias("kind_ord"),
            "n_exact",
            "n_suffix",
            F.col("_chosen.name").alias("target"),
            F.when(F.col("status").isin("exact", "paired", "suffix"), F.col("status")).alias("strength"),
            field_of(rules, F.col("_chosen.rule_ord")).alias("via"),
            "status",
        )
    )


def field_of(rules: Sequence[Rule], rule_ord: Column) -> Column:
    """The record field of a rule."""
    return F.get(F.array(*[F.lit(r.target_field) for r in rules]), rule_ord)


def consistency(resolutions: DataFrame) -> DataFrame:
    """(doc, expected, n_union, n_ambiguous, n_duplicate, conflict) per document.

    Each value has one row in ``resolutions``, so the richest kind is counted
    there too.
    """
    by_kind = (
        resolutions.groupBy("doc", "kind")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("status") == "ambiguous").alias("a"),
            F.count_if(F.col("status") == "duplicate").alias("d"),
        )
        .groupBy("doc")
        .agg(F.max("n").alias("expected"), F.sum("a").alias("n_ambiguous"), F.sum("d").alias("n_duplicate"))
    )
    claimed = (
        resolutions.where(F.col("target").isNotNull())
        .select("doc", "target")
        .distinct()
        .groupBy("doc")
        .agg(F.count(F.lit(1)).alias("n_union"))
    )
    n_union = F.coalesce("n_union", F.lit(0))
    return by_kind.join(claimed, "doc", "left").select(
        "doc",
        "expected",
        n_union.alias("n_union"),
        "n_ambiguous",
        "n_duplicate",
        ((n_union > F.col("expected")) | (F.col("n_duplicate") > 0)).alias("conflict"),
    )


def issue_targets(resolutions: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc, kind, value, type, name): the records behind each ambiguous or
    duplicate reference, one row each."""
    duplicate = F.col("status") == "duplicate"
    troubled = resolutions.where(F.col("status").isin("ambiguous", "duplicate")).select(
        "doc",
        "kind",
        "value",
        F.when(duplicate, "exact").otherwise("suffix").alias("mode"),
        F.when(duplicate, "conflict").otherwise("ambiguous").alias("type"),
    )
    named = hits.where(F.col("name").isNotNull()).select("doc", "kind", "value", "mode", "name")
    return named.join(troubled, ["doc", "kind", "value", "mode"]).select("doc", "kind", "value", "type", "name").distinct()


def issues(
    resolutions: DataFrame,
    verdicts: DataFrame,
    targets: DataFrame,
    rules: Sequence[Rule],
    target_doctype: str,
) -> DataFrame:
    """(doc, issue_ord, type, kind, value, reason): issue texts in report order.

    The texts spell out record names, so this is meant for candidates cut to
    the per-document fetch limit (``cap_per_document``), as a reviewer sees
    them. Names inside a text are sorted.
    """
    labels = _labels(rules)
    named = targets.groupBy("doc", "kind", "value", "type").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names")
    )
    label = _lookup(labels, F.col("kind"))
    quoted = F.concat(label, F.lit(" '"), F.col("value"), F.lit("' "))
    count = F.col("n").cast("string")
    duplicate = F.concat(
        quoted, F.lit("exactly matches "), count, F.lit(" different records ("), "names", F.lit(") — cannot decide")
    )
    tied = F.concat(
        quoted,
        F.lit("matches "),
        count,
        F.lit(" records ("),
        "names",
        F.lit(") with no exact key to break the tie — needs human review"),
    )
    single = named.join(resolutions.select("doc", "kind", "value", "kind_ord", "pos"), ["doc", "kind", "value"]).select(
        "doc",
        F.when(F.col("type") == "conflict", 1).otherwise(2).alias("phase"),
        F.struct("kind_ord", "pos", "value").alias("place"),
        "type",
        "kind",
        "value",
        F.when(F.col("type") == "conflict", duplicate).otherwise(tied).alias("reason"),
    )
    claim = F.concat(
        quoted, F.lit("→ "), "target", F.lit(" ("), "strength", F.lit(" "), "via", F.lit(")")
    )
    stories = (
        resolutions.where(F.col("target").isNotNull())
        .groupBy("doc")
        .agg(F.array_sort(F.collect_list(F.struct("kind_ord", "pos", "value", claim.alias("text")))).alias("_claims"))
    )
    story = F.array_join(F.transform("_claims", lambda s: s["text"]), "; ")
    over = (
        verdicts.where(F.col("n_union") > F.col("expected"))
        .join(stories, "doc")
        .select(
            "doc",
            F.lit(0).alias("phase"),
            F.struct(F.lit(0).alias("kind_ord"), F.lit(0).alias("pos"), F.lit("").alias("value")).alias("place"),
            F.lit("conflict").alias("type"),
            F.lit(None).cast("string").alias("kind"),
            F.lit(None).cast("string").alias("value"),
            F.concat(
                F.lit("references disagree: "),
                story,
                F.lit(". These references jointly describe at most "),
                F.col("expected").cast("string"),
                F.lit(f" {target_doctype} record(s) but "),
                F.col("n_union").cast("string"),
                F.lit(" different ones are claimed — not deciding; needs human review"),
            ).alias("reason"),
        )
    )
    return over.unionByName(single)


def reasons(issue_rows: DataFrame) -> DataFrame:
    """(doc, reason): the issue texts of a document joined in report order."""
    ordered = F.array_sort(F.collect_list(F.struct("phase", "place", "reason")))
    return issue_rows.groupBy("doc").agg(
        F.array_join(F.transform(ordered, lambda s: s["reason"]), "; ").alias("reason")
    )
