"""A whole reconciliation run over many documents in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertally.functions.replies import parse_reply
from papertally.operators import candidates as C
from papertally.operators import extraction as X
from papertally.operators import matching as M
from papertally.operators import quality as Q
from papertally.operators import references as R
from papertally.plans.settings import MatchSettings
from papertally.session import written


@dataclass(frozen=True)
class Checks:
    items: DataFrame
    deficiencies: DataFrame
    verdicts: DataFrame


@dataclass(frozen=True)
class Resolution:
    refs: DataFrame
    candidates: DataFrame
    hits: DataFrame
    resolutions: DataFrame
    consistency: DataFrame
    scored: DataFrame
    gate: DataFrame
    applied: DataFrame
    coverage: DataFrame


def extract_items(replies: DataFrame, schema: Sequence[Q.FieldSpec]) -> DataFrame:
    """Items of (doc, text) replies, in their normalised form."""
    parsed = replies.select("doc", parse_reply(F.col("text")).alias("reply"))
    return Q.apply_formats(X.shape_items(parsed, schema), schema)


def check_items(
    items: DataFrame,
    docs: DataFrame,
    schema: Sequence[Q.FieldSpec],
    automated: Column,
    lookups: Mapping[str, tuple[DataFrame, str, str]] | None = None,
) -> Checks:
    """All checks and the gate. ``lookups``: {key: (table, field, doctype)}.

    The items, which every check reads, and the deficiencies are written once
    (two actions); otherwise each check would parse and shape the replies again.
    """
    items = written(items)
    found = (
        Q.item_deficiencies(items, schema)
        .unionByName(Q.missing_required(items, docs, schema))
        .unionByName(Q.box_collisions(items, schema))
    )
    checked = items.withColumn("cross_check", F.lit(None).cast("string"))
    marks = []
    for key, (table, field, doctype) in (lookups or {}).items():
        result = Q.cross_check(items, table, key, field, doctype)
        marks.append(result)
        found = found.unionByName(Q.cross_check_misses(result))
    if marks:
        every = marks[0]
        for more in marks[1:]:
            every = every.unionByName(more)
        own = every.select("doc", "key", F.coalesce("idx", F.lit(-1)).alias("_i"), F.col("cross_check").alias("_c"))
        checked = (
            checked.withColumn("_i", F.coalesce("idx", F.lit(-1)))
            .join(own, ["doc", "key", "_i"], "left")
            .withColumn("cross_check", F.col("_c"))
            .drop("_i", "_c")
        )
    found = written(found)
    return Checks(checked, found, Q.gate(checked, found, schema, docs, automated))


def check_conflict(refs: DataFrame, target: DataFrame, settings: MatchSettings) -> DataFrame:
    """Fetch candidates and test the references of each document (actions: the
    references, what they find, and the resolutions are written once)."""
    own = written(refs)
    _, hits = _found(own, target, settings)
    return R.consistency(written(_resolutions(hits, settings)))


def _found(own: DataFrame, target: DataFrame, settings: MatchSettings) -> tuple[DataFrame, DataFrame]:
    """Candidates and hits of written references, from one meeting with the records."""
    met = written(C.find_matches(own, target, settings.queries))
    cands = C.with_fields(met, target)
    return cands, R.hits_of_matches(own, met, cands, settings.rules, settings.queries)


def _resolutions(hits: DataFrame, settings: MatchSettings) -> DataFrame:
    resolutions = R.resolve_references(hits, settings.rules)
    return resolutions if settings.detect_conflicts else resolutions.where(F.lit(False))


def resolve_documents(
    refs: DataFrame,
    target: DataFrame,
    settings: MatchSettings,
    context: DataFrame | None = None,
    query_cap: int | None = None,
    document_cap: int | None = None,
) -> Resolution:
    """Candidates, agreement of references, and what is applied on proof.

    ``context``: (doc, context_from, context_to). The references, their meetings
    with the records, the candidates, their hits and the resolutions, which
    later steps read, are written once (actions).
    """
    sources = list(dict.fromkeys(r.source for r in settings.rules))
    refs = written(refs)
    own = refs.where(F.col("kind").isin(sources))
    if query_cap is None and document_cap is None:
        cands, hits = _found(refs, target, settings)
        cands, hits = written(cands), written(hits)
    else:
        cands = written(C.fetch_candidates(refs, target, settings.queries, query_cap, document_cap))
        hits = written(R.reference_hits(own, cands, settings.rules))
    resolutions = written(_resolutions(hits, settings))
    verdicts = R.consistency(resolutions)
    scored = M.scored_candidates(
        cands, hits, settings.rules, settings.base_score, settings.rank_field,
        settings.rank_desc, settings.context_rows, settings.limit,
    )
    strict = M.corroborated(cands, hits, settings.rules, True, settings.suffix_autoapply)
    tied = R.issue_targets(resolutions, hits)
    gate = M.write_gate(
        cands, strict, verdicts, tied, context, settings.eligibility_field, configured=bool(settings.rules)
    )
    applied = M.apply_list(scored, gate)
    values = resolutions if settings.detect_conflicts else own
    return Resolution(own, cands, hits, resolutions, verdicts, scored, gate, applied, M.coverage(applied, values))


def fill_in_candidates(waiting: DataFrame, refs: DataFrame, target: DataFrame, settings: MatchSettings) -> DataFrame:
    """Scored candidates for runs in review that have none stored, limited to
    documents with a look-up window (``waiting``: doc, context_from, context_to)."""
    asked = refs.join(waiting.select("doc").distinct(), "doc", "left_semi")
    return resolve_documents(asked, target, settings, waiting).scored
