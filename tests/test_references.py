"""The reference-consistency cases, and independence of the row order."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from papertally.operators import candidates as C
from papertally.operators import matching as M
from papertally.operators import references as R
from papertally.plans import reconcile as P
from papertally.plans.settings import match_settings

A, B_, C_, D, E = (
    ("INV2627-00311", "582012827096"), ("SOI2627-00327", None), ("INV2627-00099", "999999999999"),
    ("INV2627-00327", None), ("INV2627-00312", "111111111111"),
)
CORROBORATE = [
    {"target_field": "ewaybill", "from": "eway_bills", "label": "e-way bill"},
    {"target_field": "name", "from": "bill_numbers", "label": "bill number"},
    {"target_field": "name", "from": "bill_numbers", "match": "numeric_suffix", "label": "bill number"},
]
RULES = R.rules_of(CORROBORATE)

CASES = {
    "UC1": (["582012827096"], ["SOI2627-00327"], [A, B_]),
    "UC1s": (["582012827096"], ["00327"], [A, B_]),
    "UC2": (["582012827096", "999999999999"], ["SOI2627-00327"], [A, C_, B_]),
    "UC3": ([], ["327"], [B_, D]),
    "UC4": (["582012827096"], [], [A, B_]),
    "UC9": (["582012827096", "111111111111"], ["00311", "00312"], [A, E]),
    "UC9b": (["582012827096"], ["00311", "00312", "00399"], [A, E, C_]),
}


def tables(spark):
    refs, cands = [], []
    for doc, (eways, bills, rows) in CASES.items():
        refs += [(doc, "eway_bills", v, i) for i, v in enumerate(eways)]
        refs += [(doc, "bill_numbers", v, i) for i, v in enumerate(bills)]
        cands += [(doc, n, e, f"{i}") for i, (n, e) in enumerate(rows)]
    return (
        spark.createDataFrame(refs, "doc string, kind string, value string, pos int"),
        spark.createDataFrame(cands, "doc string, name string, ewaybill string, fetch_pos string"),
    )


@pytest.fixture(scope="module")
def solved(spark):
    refs, cands = tables(spark)
    hits = R.reference_hits(refs, cands, RULES).cache()
    resolutions = R.resolve_references(hits, RULES).cache()
    verdicts = R.consistency(resolutions).cache()
    return refs, cands, hits, resolutions, verdicts


def test_conflicts(solved):
    got = {r.doc: r for r in solved[4].collect()}
    assert {d for d, r in got.items() if r.conflict} == {"UC1", "UC1s", "UC2"}
    assert (got["UC2"].expected, got["UC2"].n_union) == (2, 3)
    assert (got["UC9"].expected, got["UC9"].n_union) == (2, 2)
    assert got["UC3"].n_ambiguous == 1


def test_strengths(solved):
    got = {(r.doc, r.value): (r.target, r.strength, r.via) for r in solved[3].collect()}
    assert got[("UC9", "00311")] == (A[0], "paired", "name")
    assert got[("UC9b", "00312")] == (E[0], "suffix", "name")
    assert got[("UC9b", "00399")] == (None, None, None)
    assert got[("UC1", "SOI2627-00327")] == (B_[0], "exact", "name")


def test_reasons(solved):
    _, _, hits, resolutions, verdicts = solved
    rows = R.issues(resolutions, verdicts, R.issue_targets(resolutions, hits), RULES, "Sales Invoice")
    got = {r.doc: r.reason for r in R.reasons(rows).collect()}
    assert set(got) == {"UC1", "UC1s", "UC2", "UC3"}
    assert all(x in got["UC1"] for x in (A[0], B_[0], "582012827096"))
    assert all(n in got["UC2"] for n in (A[0], B_[0], C_[0]))
    assert got["UC3"] == (
        "bill number '327' matches 2 records (INV2627-00327, SOI2627-00327) with no exact key to break the tie — needs human review"
    )


def test_order_does_not_matter(spark, solved):
    refs, cands = tables(spark)
    shuffled = R.resolve_references(
        R.reference_hits(refs.repartition(5).orderBy(F.rand(3)), cands.repartition(3).orderBy(F.rand(4)), RULES), RULES
    )
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, solved[3].collect()))


def _gate(solved, autoapply):
    refs, cands, hits, resolutions, verdicts = solved
    strict = M.corroborated(cands, hits, RULES, for_gate=True, suffix_autoapply=autoapply)
    return M.write_gate(cands, strict, verdicts, R.issue_targets(resolutions, hits))


def test_gate(solved):
    loose = {(r.doc, r.name): r.allowed for r in _gate(solved, True).collect()}
    assert loose[("UC3", B_[0])] is False and loose[("UC3", D[0])] is False
    assert loose[("UC9b", E[0])] is True
    strict = {(r.doc, r.name): r.allowed for r in _gate(solved, False).collect()}
    assert strict[("UC9b", E[0])] is False and strict[("UC9b", A[0])] is True
    assert strict[("UC1", A[0])] is False


def test_applied(solved):
    refs, cands, hits, *_ = solved
    applied = M.apply_list(M.scored_candidates(cands, hits, RULES), _gate(solved, False))
    got = {}
    for r in applied.collect():
        got.setdefault(r.doc, set()).add(r.target)
    assert got == {"UC4": {A[0]}, "UC9": {A[0], E[0]}, "UC9b": {A[0]}}
    covered = {r.doc: r.resolved for r in M.coverage(applied, refs).collect()}
    assert covered["UC4"] and not covered["UC9"] and not covered["UC9b"]


def test_answer_against_a_proof_is_a_conflict(spark, solved):
    _, cands, hits, resolutions, verdicts = solved
    rows = [("UC4", 0, B_[0], 0.95, "bill"), ("UC4", 1, "invented", 1.0, ""), ("UC3", 0, D[0], 7.0, ""), ("UC9", 0, A[0], 0.5, "")]
    answers = spark.createDataFrame(rows, "doc string, pos int, target string, confidence double, reason string")
    kept, judged = M.validate_answers(answers, cands)
    assert {(r.doc, r.target, r.confidence) for r in kept.collect()} == {("UC4", B_[0], 0.95), ("UC3", D[0], 1.0), ("UC9", A[0], 0.5)}
    tied = R.issue_targets(resolutions, hits).where("type = 'ambiguous'")
    matches, final = M.match_verdict(kept, judged, M.corroborated(cands, hits, RULES), resolutions, verdicts, tied)
    status = {r.doc: r.status for r in final.collect()}
    assert (status["UC4"], status["UC3"], status["UC9"], status["UC1"], status["UC9b"]) == ("conflict", "doubt", "doubt", "conflict", "none")
    proofs = {(r.doc, r.target) for r in matches.where("proof").collect()}
    assert ("UC4", A[0]) in proofs and ("UC9", E[0]) in proofs


def test_whole_run_from_settings(spark):
    refs, _ = tables(spark)
    rows = [A, B_, C_, D, E]
    target = spark.createDataFrame([(n, e, 1) for n, e in rows], "name string, ewaybill string, docstatus int")
    config = {
        "target_doctype": "Sales Invoice",
        "candidate_query": [
            {"or_filters": {"ewaybill": ["in", "{eway_bills}"]}, "filters": {"docstatus": 1}},
            {"or_filters": [["name", "like", "%{bill_numbers}%"]]},
        ],
        "corroborate": CORROBORATE,
    }
    settings = match_settings(config)
    run = P.resolve_documents(refs, target, settings)
    cands = {(r.doc, r.name) for r in run.candidates.collect()}
    assert ("UC1s", B_[0]) in cands and ("UC1s", D[0]) in cands and ("UC4", A[0]) in cands and ("UC4", B_[0]) not in cands
    off = match_settings({**config, "detect_conflicts": 0})
    assert P.check_conflict(refs, target, off).count() == 0
    assert match_settings("{broken") is None and match_settings({"x": 1}) is None
    assert {r.doc for r in run.applied.collect()} >= {"UC4", "UC9b"}


def test_union_is_idempotent(spark):
    rows = spark.createDataFrame([("d", "a", "1"), ("d", "b", "2")], "doc string, name string, fetch_pos string")
    once = C.union_first([rows])
    twice = C.union_first([rows, rows])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
