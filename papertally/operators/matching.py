"""Scoring, answers, verdicts and what may be applied without a human."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertally.functions.positions import keep_first, top_rows
from papertally.operators.candidates import eligible
from papertally.operators.references import Rule, field_of, reference_hits
from papertally.session import written

# Default scores, answer threshold, text lengths.
BASE_SCORE = 0.4
SUFFIX_SCORE = 0.7
EXACT_SCORE = 0.95
ANSWER_THRESHOLD = 0.8
CANDIDATE_LIMIT = 8


def _rule_scores(rules: Sequence[Rule]) -> Column:
    scores = [r.score or (EXACT_SCORE if r.mode == "exact" else SUFFIX_SCORE) for r in rules]
    return F.get(F.array(*[F.lit(float(s)) for s in scores]), F.col("rule_ord"))


def corroborated(
    cands: DataFrame, hits: DataFrame, rules: Sequence[Rule], for_gate: bool = False, suffix_autoapply: bool = False
) -> DataFrame:
    """(doc, name, corroborated): does any rule link the record to the document?

    Null for every row when there are no rules. For an automatic write a
    trailing number alone does not count unless ``suffix_autoapply`` is set.
    ``hits`` is :func:`papertally.operators.references.reference_hits`.
    """
    pairs = cands.select("doc", "name").distinct()
    if not rules:
        return pairs.withColumn("corroborated", F.lit(None).cast("boolean"))
    linked = hits.where(F.col("name").isNotNull())
    if for_gate and not suffix_autoapply:
        linked = linked.where(F.col("mode") == "exact")
    linked = linked.select("doc", "name").distinct().withColumn("_hit", F.lit(True))
    return pairs.join(linked, ["doc", "name"], "left").select(
        "doc", "name", F.coalesce("_hit", F.lit(False)).alias("corroborated")
    )


def evidence(hits: DataFrame, rules: Sequence[Rule], base_score: float = BASE_SCORE) -> DataFrame:
    """(doc, name, confidence, matched_value, via, kind, mode): the rule that
    scores each record, in one aggregate.

    Rules apply in order: a trailing number raises the score if it is higher
    (the earliest rule among equals), the first exact rule sets it and ends the
    scan. Of several values that fit the rule the first one in the document
    counts; for an exact rule it is the record's own text.
    """
    exact = F.col("mode") == "exact"
    raises = (F.col("mode") == "suffix") & (_rule_scores(rules) > base_score)
    # what a rule says of itself is looked up afterwards and doesn't travel
    order = F.struct(
        (~exact).alias("late"), F.when(exact, 0.0).otherwise(-_rule_scores(rules)).alias("s"), "rule_ord", "pos", "value"
    )
    of_rule = lambda said: F.get(F.array(*[F.lit(x) for x in said]), F.col("rule_ord"))
    return (
        hits.where(F.col("name").isNotNull() & (exact | raises))
        .groupBy("doc", "name")
        .agg(F.min(order).alias("_e"))
        .select("doc", "name", F.col("_e.value").alias("matched_value"), F.col("_e.rule_ord").alias("rule_ord"))
        .select(
            "doc",
            "name",
            _rule_scores(rules).alias("confidence"),
            "matched_value",
            field_of(rules, F.col("rule_ord")).alias("via"),
            of_rule([r.source for r in rules]).alias("kind"),
            of_rule([r.mode for r in rules]).alias("mode"),
        )
    )


def scored_candidates(
    cands: DataFrame,
    hits: DataFrame,
    rules: Sequence[Rule],
    base_score: float = BASE_SCORE,
    rank_field: str | None = None,
    rank_desc: bool = True,
    context_rows: int = 0,
    limit: int = CANDIDATE_LIMIT,
) -> DataFrame:
    """(doc, name, confidence, reason, matched_value, matched_field, rank_text,
    query_ord, fetch_pos): candidates with the evidence that supports them.

    Rows with evidence are all kept; rows without are cut to ``context_rows``
    and to what ``limit`` leaves.
    """
    base = base_score or BASE_SCORE
    found = evidence(hits, rules, base)
    how = "left" if context_rows > 0 else "inner"
    rank_text = F.coalesce(F.col(rank_field).cast("string"), F.lit("")) if rank_field else F.lit("")
    query_ord = F.col("query_ord") if "query_ord" in cands.columns else F.lit(0)
    listed = cands.select("doc", "name", query_ord.alias("query_ord"), "fetch_pos", rank_text.alias("rank_text"))
    said = (
        F.when(
            F.col("mode") == "exact",
            F.concat(F.lit("exact "), F.col("via"), F.lit(" matches the document's "), F.col("kind")),
        )
        .when(
            F.col("mode") == "suffix",
            F.concat(F.col("via"), F.lit(" ends with the document's "), F.col("kind")),
        )
        .otherwise(F.lit("matches the candidate search"))
    )
    scored = listed.join(found, ["doc", "name"], how).select(
        "doc",
        "name",
        F.coalesce("confidence", F.lit(float(base))).alias("confidence"),
        said.alias("reason"),
        "matched_value",
        F.col("via").alias("matched_field"),
        "rank_text",
        "query_ord",
        "fetch_pos",
    )
    strong = scored.where(F.col("matched_value").isNotNull())
    if context_rows <= 0:
        return strong
    order = ranking(rank_desc)
    weak = top_rows(scored.where(F.col("matched_value").isNull()), ["doc"], order, context_rows, "_n")
    taken = strong.groupBy("doc").agg(F.count(F.lit(1)).alias("_taken"))
    kept = (
        weak.join(taken, "doc", "left")
        .where(F.col("_n") <= F.greatest(F.lit(limit) - F.coalesce("_taken", F.lit(0)), F.lit(0)))
        .select(*strong.columns)
    )
    return strong.unionByName(kept)


def scored_by_lists(docs: DataFrame, lists: DataFrame, refs: DataFrame, rules: Sequence[Rule], **options) -> DataFrame:
    """:func:`scored_candidates` where documents share lists of candidates.

    ``docs``: (doc, list), ``lists``: (list, name, fetch_pos, ...). Candidates of
    a document are the records of its lists. Rows grow with the product of
    documents and records, but scores depend on the lists and the references
    alone: documents with the same ones are scored once, and each reads its rows
    off in the last join, which shuffles none of them. A document's references and
    the names of its lists are gathered in one row. Documents, their kinds, the
    scores of a kind and the kind of each document are written (actions).
    """
    bags = docs.where(F.col("list").isNotNull()).groupBy("doc", "list").agg(F.count(F.lit(1)).alias("n"))
    held = bags.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("list", "n"))).alias("_lists"))
    used = refs.where(F.col("doc").isNotNull() & F.col("value").isNotNull() & F.col("kind").isin([r.source for r in rules]))
    said = used.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set(F.struct("kind", "value", "pos")).alias("_refs"))
    own = held.join(said, F.col("doc") == F.col("_doc"), "left").drop("_doc")
    none = F.array().cast(said.schema["_refs"].dataType)
    own = written(own.withColumn("_refs", F.sort_array(F.coalesce("_refs", none))))
    kinds = written(own.select("_lists", "_refs").distinct().withColumn("_kind", F.monotonically_increasing_id()))
    listed = kinds.select(F.col("_kind").alias("doc"), F.inline("_lists"))
    listed = listed.select("doc", "list", F.explode(F.expr("array_repeat(0, CAST(n AS INT))")).alias("_copy"))
    cands = listed.drop("_copy").join(lists, "list").drop("list")
    asked = kinds.select(F.col("_kind").alias("doc"), F.inline("_refs"))
    scored = written(scored_candidates(cands, reference_hits(asked, cands, rules), rules, **options).withColumnRenamed("doc", "_kind"))
    # documents of a kind stand together, so that the rows they give, written, shrink to a few bits
    of_kind = written(own.join(kinds, ["_lists", "_refs"]).select("doc", "_kind").sortWithinPartitions("_kind"))
    return of_kind.join(scored, "_kind").drop("_kind")


def ranking(rank_desc: bool = True) -> list[Column]:
    """Order of candidates: confidence, then the rank text, then fetch order."""
    rank = F.col("rank_text").desc() if rank_desc else F.col("rank_text").asc()
    return [F.col("confidence").desc(), rank, F.col("query_ord").asc(), F.col("fetch_pos").asc(), F.col("name").asc()]


def ranked_candidates(scored: DataFrame, rank_desc: bool = True) -> DataFrame:
    """Scored candidates with their ``rank`` in the document, from 1: those with
    evidence, then the others, each in the order of :func:`ranking`."""
    shown = F.col("matched_value").isNull().cast("int")
    return top_rows(scored, ["doc"], [shown, *ranking(rank_desc)], None, "rank")


def validate_answers(
    answers: DataFrame, cands: DataFrame, threshold: float = ANSWER_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """Check model answers (doc, pos, target, confidence, reason).

    Targets that are not candidates are dropped, confidence is cut to 0..1, and
    the best answer per target is kept, the earlier one among equals. Gives the
    kept answers and (doc, best, status) for every document with candidates.
    """
    known = cands.select("doc", F.col("name").alias("target")).distinct()
    sure = F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    clean = answers.join(known, ["doc", "target"], "left_semi").select(
        "doc",
        "target",
        "pos",
        sure.alias("confidence"),
        F.coalesce("reason", F.lit("")).alias("reason"),
    )
    kept = keep_first(clean, ["doc", "target"], F.struct((-F.col("confidence")).alias("c"), "pos"))
    best = kept.groupBy("doc").agg(F.max("confidence").alias("best"))
    status = (
        F.when(F.col("best").isNull(), "none").when(F.col("best") >= threshold, "matched").otherwise("doubt")
    )
    verdicts = (
        cands.select("doc")
        .distinct()
        .join(best, "doc", "left")
        .select("doc", F.coalesce("best", F.lit(0.0)).alias("best"), status.alias("status"))
    )
    return kept, verdicts


def match_verdict(
    answers: DataFrame,
    answer_verdicts: DataFrame,
    linked: DataFrame,
    resolutions: DataFrame,
    verdicts: DataFrame,
    tied: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Final matches and (doc, status, corroborated) per document.

    ``linked`` is :func:`corroborated`, ``tied`` the ambiguous rows of
    ``issue_targets``. One answer without a shared key makes a match doubtful;
    proven records that were not picked are added, once per proving reference;
    a contradiction, or a pick no reference supports while a proof exists, is
    a conflict; a pick tied in an ambiguity is doubtful.
    """
    picked = answers.join(linked.withColumnRenamed("name", "target"), ["doc", "target"], "left")
    missed = (
        resolutions.where(F.col("strength") == "exact")
        .join(answers.select("doc", "target"), ["doc", "target"], "left_anti")
        .select(
            "doc",
            "target",
            F.lit(0.95).alias("confidence"),
            F.concat(
                F.lit("deterministic proof: exact "), "via", F.lit(" matches the document's "), "kind"
            ).alias("reason"),
            F.lit(True).alias("corroborated"),
            F.lit(True).alias("proof"),
        )
    )
    matches = picked.select(
        "doc", "target", "confidence", "reason", "corroborated", F.lit(False).alias("proof")
    ).unionByName(missed)

    claimed = resolutions.where(F.col("target").isNotNull()).select("doc", "target").distinct()
    supported = picked.join(claimed.withColumn("_in", F.lit(True)), ["doc", "target"], "left").join(
        tied.select("doc", F.col("name").alias("target")).distinct().withColumn("_tied", F.lit(True)),
        ["doc", "target"],
        "left",
    )
    per_pick = supported.groupBy("doc").agg(
        F.every("corroborated").alias("corroborated"),
        F.bool_or(F.col("_in").isNull()).alias("_unsupported"),
        F.bool_or(F.col("_tied").isNotNull()).alias("_picked_tie"),
    )
    proven = resolutions.groupBy("doc").agg(F.bool_or(F.col("strength") == "exact").alias("_proven"))
    no = F.lit(False)
    doubted = F.when(
        (F.col("corroborated") == F.lit(False)) & (F.col("status") == "matched"), "doubt"
    ).otherwise(F.col("status"))
    clash = F.coalesce("conflict", no) | (F.coalesce("_proven", no) & F.coalesce("_unsupported", no))
    final = (
        F.when(clash, "conflict")
        .when(F.coalesce("_picked_tie", no) & (F.col("_doubted") == "matched"), "doubt")
        .otherwise(F.col("_doubted"))
    )
    per_doc = (
        answer_verdicts.join(per_pick, "doc", "left")
        .join(proven, "doc", "left")
        .join(verdicts.select("doc", "conflict"), "doc", "left")
        .withColumn("_doubted", doubted)
        .select("doc", "best", final.alias("status"), "corroborated")
    )
    return matches, per_doc


def write_gate(
    cands: DataFrame,
    linked_strict: DataFrame,
    verdicts: DataFrame,
    tied: DataFrame,
    context: DataFrame | None = None,
    eligibility_field: str | None = None,
    declared: bool = True,
    configured: bool = True,
) -> DataFrame:
    """(doc, name, allowed): may this record be written without a human?

    Null when the tool declares no gate; false when a declared gate has no
    usable configuration, the record is outside the document's window
    (``context``: doc, context_from, context_to), the document contradicts
    itself, the record is tied, or no exact key links it.
    """
    pairs = cands.dropDuplicates(["doc", "name"])
    if not declared or not configured:
        answer = F.lit(None if not declared else False).cast("boolean")
        return pairs.select("doc", "name", answer.alias("allowed"))
    if eligibility_field and context is not None:
        pairs = pairs.join(context, "doc", "left").withColumn(
            "_inside", eligible(F.col(eligibility_field), F.col("context_from"), F.col("context_to"))
        )
    else:
        pairs = pairs.withColumn("_inside", F.lit(True))
    ties = tied.where(F.col("type") == "ambiguous").select("doc", "name").distinct()
    no = F.lit(False)
    allowed = (
        F.when(~F.col("_inside"), no)
        .when(F.coalesce("conflict", no), no)
        .when(F.col("_tied").isNotNull(), no)
        .otherwise(F.coalesce("corroborated", no))
    )
    return (
        pairs.select("doc", "name", "_inside")
        .join(verdicts.select("doc", "conflict"), "doc", "left")
        .join(ties.withColumn("_tied", F.lit(True)), ["doc", "name"], "left")
        .join(linked_strict, ["doc", "name"], "left")
        .select("doc", "name", allowed.alias("allowed"))
    )


def apply_list(scored: DataFrame, gate: DataFrame) -> DataFrame:
    """(doc, ref, target): what is applied on proof alone.

    A reference applies when exactly one of the candidates that answer it
    passes the gate. A scored candidate answers one reference only, so no
    record is applied twice.
    """
    answering = scored.where(F.col("matched_value").isNotNull()).join(
        gate.where(F.col("allowed")).select("doc", "name"), ["doc", "name"]
    )
    return (
        answering.groupBy("doc", F.col("matched_value").alias("ref"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("target"))
        .where(F.col("n") == 1)
        .select("doc", "ref", "target")
    )


def coverage(applied: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc, n_refs, n_applied, resolved): is every reference value applied?"""
    wanted = refs.select("doc", F.col("value").alias("ref")).distinct()
    marked = wanted.join(applied.withColumn("_done", F.lit(True)), ["doc", "ref"], "left")
    return marked.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_refs"),
        F.count("_done").alias("n_applied"),
        (F.count("_done") == F.count(F.lit(1))).alias("resolved"),
    )
