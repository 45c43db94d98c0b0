"""Candidates, agreement of references, proof, answers, learning, vectors.

Documents are orders. The records they refer to are ``parties``: customers
(name and key) and suppliers (name only, so their key is unknown). A document
refers to its customer by key (kind ``account``, not for orders in progress)
and to parties by the number in their name (kind ``tail``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertally.catalog.registry import ORACLE, Tables, query
from papertally.operators import candidates as C
from papertally.operators import learning as L
from papertally.operators import matching as M
from papertally.operators import quality as Q
from papertally.operators import references as R
from papertally.operators import semantic as S
from papertally.plans import reconcile as P
from papertally.plans.settings import match_settings
from papertally.session import written

RULES = R.rules_of(
    [
        {"target_field": "key", "from": "account", "label": "account number"},
        {"target_field": "name", "from": "tail", "match": "numeric_suffix", "label": "party number"},
    ]
)

SETTINGS = {
    "target_doctype": "Party",
    "candidate_query": [
        {"keys": [{"field": "key", "from": "account"}]},
        {"keys": [{"field": "name", "from": "tail", "match": "suffix"}]},
    ],
    "corroborate": [
        {"target_field": "key", "from": "account", "label": "account number"},
        {"target_field": "name", "from": "tail", "match": "numeric_suffix", "label": "party number"},
    ],
    "rank": {"field": "since"},
    "eligibility": {"field": "since"},
}


def parties(t: Tables) -> DataFrame:
    since = F.date_add(F.lit("1994-06-01").cast("date"), (F.col("c_custkey") % 3000).cast("int"))
    customers = t.customer.select(
        F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("key"), since.cast("string").alias("since")
    )
    suppliers = t.supplier.select(
        F.col("s_name").alias("name"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("since")
    )
    return customers.unionByName(suppliers)


def references(t: Tables) -> DataFrame:
    accounts = t.orders.where(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("doc"), F.lit("account").alias("key"), F.lit(0).alias("idx"), F.col("o_custkey").cast("string").alias("value")
    )
    tails = t.lineitem.select(
        F.col("l_orderkey").alias("doc"),
        F.lit("tail").alias("key"),
        F.col("l_linenumber").alias("idx"),
        F.concat(F.lit("00"), F.col("l_partkey")).alias("value"),
    )
    return C.reference_values(accounts.unionByName(tails))


PARTIES = """
    parties AS (
      SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS key, c_custkey AS num,
             CAST(CAST(DATE '1994-06-01' + CAST(c_custkey % 3000 AS INTEGER) AS DATE) AS VARCHAR) AS since FROM customer
      UNION ALL SELECT s_name, NULL, s_suppkey, NULL FROM supplier),
    refs AS (
      SELECT o_orderkey AS doc, 'account' AS kind, CAST(o_custkey AS VARCHAR) AS value, o_custkey AS num, 0 AS pos
      FROM orders WHERE o_orderstatus <> 'P'
      UNION ALL
      SELECT l_orderkey, 'tail', '00' || l_partkey, l_partkey, min(l_linenumber)
      FROM lineitem GROUP BY l_orderkey, l_partkey)
    """

RESOLVED = """
    hits AS (
      SELECT r.doc, r.kind, r.value, r.pos, p.name FROM refs r JOIN parties p
      ON (r.kind = 'account' AND p.key = r.value) OR (r.kind = 'tail' AND p.num = r.num)),
    proven AS (
      SELECT DISTINCT doc, min(name) AS name FROM hits WHERE kind = 'account'
      GROUP BY doc, value HAVING count(DISTINCT name) = 1),
    counted AS (
      SELECT r.doc, r.kind, r.value, r.pos,
             count(DISTINCT CASE WHEN r.kind = 'account' THEN h.name END) AS n_exact,
             count(DISTINCT CASE WHEN r.kind = 'tail' THEN h.name END) AS n_suffix,
             count(DISTINCT CASE WHEN r.kind = 'tail' THEN p.name END) AS n_paired,
             min(h.name) AS any_name, min(CASE WHEN r.kind = 'tail' THEN p.name END) AS paired_name
      FROM refs r LEFT JOIN hits h ON h.doc = r.doc AND h.kind = r.kind AND h.value = r.value
      LEFT JOIN proven p ON p.doc = h.doc AND p.name = h.name
      GROUP BY r.doc, r.kind, r.value, r.pos),
    resolved AS (
      SELECT *, CASE status WHEN 'exact' THEN any_name WHEN 'paired' THEN paired_name WHEN 'suffix' THEN any_name END AS target
      FROM (SELECT *, CASE WHEN n_exact = 1 THEN 'exact' WHEN n_exact > 1 THEN 'duplicate' WHEN n_paired = 1 THEN 'paired'
                           WHEN n_suffix = 1 THEN 'suffix' WHEN n_suffix > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status
            FROM counted) q),
    verdicts AS (
      SELECT doc, expected, n_union, n_ambiguous, n_duplicate, (n_union > expected OR n_duplicate > 0) AS conflict
      FROM (SELECT doc, max(n) AS expected, max(n_union) AS n_union, max(n_ambiguous) AS n_ambiguous, max(n_duplicate) AS n_duplicate
            FROM (SELECT doc, kind, count(*) AS n FROM resolved GROUP BY doc, kind) k
            JOIN (SELECT doc, count(DISTINCT target) AS n_union, count(*) FILTER (status = 'ambiguous') AS n_ambiguous,
                         count(*) FILTER (status = 'duplicate') AS n_duplicate FROM resolved GROUP BY doc) u USING (doc)
            GROUP BY doc) v)
    """


@query(
    "reference_values",
    "SELECT l_orderkey AS doc, 'part' AS kind, l_partkey::VARCHAR AS value, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2, 3",
)
def reference_values(t: Tables) -> DataFrame:
    items = t.lineitem.select(
        F.col("l_orderkey").alias("doc"), F.lit("part").alias("key"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").cast("string").alias("value")
    )
    return C.reference_values(items)


@query(
    "richest_kind",
    "WITH" + PARTIES + "SELECT doc, max(n) AS expected FROM (SELECT doc, kind, count(*) AS n FROM refs GROUP BY 1, 2) k GROUP BY 1",
)
def richest_kind(t: Tables) -> DataFrame:
    return C.richest_kind(references(t))


@query(
    "in_list_candidates",
    "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT 'Brand#' || n_nationkey FROM nation WHERE n_regionkey <> 2)",
)
def in_list_candidates(t: Tables) -> DataFrame:
    values = t.nation.where(F.col("n_regionkey") != 2).select(F.concat(F.lit("Brand#"), "n_nationkey").alias("value"))
    return C.in_list(t.part, values, "p_brand").select("p_partkey", "p_brand")


@query(
    "not_in_list_candidates",
    "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT 'Brand#' || n_nationkey FROM nation WHERE n_regionkey <> 2)",
)
def not_in_list_candidates(t: Tables) -> DataFrame:
    values = t.nation.where(F.col("n_regionkey") != 2).select(F.concat(F.lit("Brand#"), "n_nationkey").alias("value"))
    return C.in_list(t.part, values, "p_brand", negate=True).select("p_partkey", "p_brand")


@query("exact_candidates", "SELECT o_orderkey AS doc, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey")
def exact_candidates(t: Tables) -> DataFrame:
    refs = t.orders.select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").cast("string").alias("value"))
    return C.exact_join(refs, t.customer, "c_custkey").select("doc", F.col("c_name").alias("name"))


@query(
    "suffix_join",
    """
    SELECT o_orderkey AS doc, c_name AS name FROM orders JOIN customer
    ON CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) = o_custkey
    """,
)
def suffix_join(t: Tables) -> DataFrame:
    value = F.concat(F.lit("INV-0"), F.col("o_custkey"))
    refs = t.orders.select(F.col("o_orderkey").alias("doc"), value.alias("value"))
    return C.suffix_join(refs, t.customer, "c_name").select("doc", F.col("c_name").alias("name"))


@query(
    "like_candidates",
    """
    SELECT r.doc, r.value, p.p_partkey AS name FROM
      (SELECT DISTINCT s_nationkey AS doc, right(s_name, 2) AS value FROM supplier) r
    JOIN part p ON (p.p_name || p.p_partkey) LIKE '%' || r.value || '%'
    UNION ALL
    SELECT r.doc, r.value, p.p_partkey FROM (SELECT DISTINCT n_regionkey AS doc, 'd_g%' AS value FROM nation) r
    JOIN part p ON (p.p_name || p.p_partkey) LIKE '%' || r.value || '%'
    """,
)
def like_candidates(t: Tables) -> DataFrame:
    tails = t.supplier.select(F.col("s_nationkey").alias("doc"), F.right("s_name", F.lit(2)).alias("value")).distinct()
    wild = t.nation.select(F.col("n_regionkey").alias("doc"), F.lit("d_g%").alias("value")).distinct()
    target = t.part.select(F.col("p_partkey").alias("name"), F.concat("p_name", F.col("p_partkey")).alias("text"))
    return C.contains_join(tails.unionByName(wild), target, "text").select("doc", "value", "name")


@query(
    "like_candidates_all",
    """
    SELECT r.doc, p.p_partkey AS name FROM
      (SELECT n_nationkey AS doc, n_regionkey || '' AS a, n_nationkey || '' AS b FROM nation) r
    JOIN part p ON p.p_name || p.p_partkey LIKE '%' || r.a || '%' AND p.p_name || p.p_partkey LIKE '%' || r.b || '%'
    """,
)
def like_candidates_all(t: Tables) -> DataFrame:
    """LIKE conditions inside ``filters`` hold together: a record must contain
    every value of the document."""
    values = F.array_distinct(F.array(F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")))
    refs = t.nation.select(F.col("n_nationkey").alias("doc"), F.explode(values).alias("value"))
    target = t.part.select(F.col("p_partkey").alias("name"), F.concat("p_name", F.col("p_partkey")).alias("text"))
    return C.contains_every(refs, target, "text").select("doc", "name")


@query(
    "candidate_union_cap",
    "WITH"
    + PARTIES
    + """
    , q0 AS (SELECT DISTINCT r.doc, p.name FROM refs r JOIN parties p ON r.kind = 'account' AND p.key = r.value),
    q1 AS (SELECT doc, name FROM (
             SELECT doc, name, row_number() OVER (PARTITION BY doc ORDER BY name) AS n
             FROM (SELECT DISTINCT r.doc, p.name FROM refs r JOIN parties p ON r.kind = 'tail' AND p.num = r.num) d) e WHERE n <= 4),
    u AS (SELECT doc, name, min(o) AS query_ord FROM (SELECT *, 0 AS o FROM q0 UNION ALL SELECT *, 1 FROM q1) x GROUP BY 1, 2)
    SELECT doc, name, query_ord FROM (
      SELECT *, row_number() OVER (PARTITION BY doc ORDER BY query_ord, name) AS n FROM u) y WHERE n <= 3
    """,
)
def candidate_union_cap(t: Tables) -> DataFrame:
    settings = match_settings(SETTINGS)
    fetched = C.fetch_candidates(references(t), parties(t), settings.queries, query_cap=4, document_cap=3)
    return fetched.select("doc", "name", "query_ord")


@query(
    "candidates_whole",
    "WITH"
    + PARTIES
    + """
    SELECT DISTINCT r.doc, p.name, p.since FROM refs r JOIN parties p
    ON (r.kind = 'account' AND p.key = r.value) OR (r.kind = 'tail' AND p.num = r.num)
    """,
)
def candidates_whole(t: Tables) -> DataFrame:
    settings = match_settings(SETTINGS)
    return C.fetch_candidates(references(t), parties(t), settings.queries).select("doc", "name", "since")


@query(
    "candidates_contains",
    """
    WITH refs AS (SELECT o_orderkey AS doc, '%' || right(CAST(o_orderkey AS VARCHAR), 3) || '%' AS tail, CAST(o_custkey AS VARCHAR) AS account FROM orders)
    SELECT doc, name, min(query_ord) AS query_ord FROM (
      SELECT doc, c_name AS name, 0 AS query_ord FROM refs JOIN customer ON CAST(c_custkey AS VARCHAR) = account
      UNION ALL
      SELECT doc, c_name, 1 FROM refs JOIN (SELECT tail AS t, c_name FROM (SELECT DISTINCT tail FROM refs) JOIN customer
                                            ON c_name || '/' || c_mktsegment LIKE tail AND c_nationkey = 7) ON t = tail) GROUP BY doc, name
    """,
)
def candidates_contains(t: Tables) -> DataFrame:
    """A strong key, and a text that holds the last digits of the document's number."""
    one = lambda kind, value: t.orders.select(
        F.col("o_orderkey").alias("doc"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), F.lit(0).alias("pos")
    )
    refs = one("account", F.col("o_custkey")).unionByName(one("tail", F.right(F.col("o_orderkey").cast("string"), F.lit(3))))
    text = F.concat("c_name", F.lit("/"), "c_mktsegment")
    target = t.customer.select(
        F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("key"), F.col("c_nationkey").alias("nation"), text.alias("text")
    )
    queries = [{"keys": [{"field": "key", "from": "account"}]}, {"keys": [{"field": "text", "from": "tail", "match": "contains"}], "filters": {"nation": 7}}]
    return C.fetch_candidates(refs, target, queries).select("doc", "name", "query_ord")


@query(
    "reference_resolutions",
    "WITH" + PARTIES + "," + RESOLVED + "SELECT doc, kind, value, n_exact, n_suffix, status, target FROM resolved",
)
def reference_resolutions(t: Tables) -> DataFrame:
    run = P.resolve_documents(references(t), parties(t), match_settings(SETTINGS))
    return run.resolutions.select("doc", "kind", "value", "n_exact", "n_suffix", "status", "target")


@query(
    "references_consistency",
    "WITH" + PARTIES + "," + RESOLVED + "SELECT doc, expected, n_union, n_ambiguous, n_duplicate, conflict FROM verdicts",
)
def references_consistency(t: Tables) -> DataFrame:
    return P.check_conflict(references(t), parties(t), match_settings(SETTINGS))


_REASONS = """
    , named AS (
      SELECT r.doc, r.kind, r.value, r.pos, count(*) AS n, string_agg(h.name, ', ' ORDER BY h.name) AS names
      FROM resolved r JOIN (SELECT DISTINCT doc, kind, value, name FROM hits) h
        ON h.doc = r.doc AND h.kind = r.kind AND h.value = r.value
      WHERE r.status = 'ambiguous' GROUP BY 1, 2, 3, 4),
    claims AS (
      SELECT doc, string_agg(CASE kind WHEN 'account' THEN 'account number' ELSE 'party number' END || ' ''' || value
             || ''' → ' || target || ' (' || status || ' ' || CASE kind WHEN 'account' THEN 'key' ELSE 'name' END || ')', '; '
             ORDER BY kind, pos, value) AS story
      FROM resolved WHERE target IS NOT NULL GROUP BY doc),
    issues AS (
      SELECT v.doc, 0 AS phase, 0 AS pos, '' AS value, 'references disagree: ' || c.story
             || '. These references jointly describe at most ' || v.expected || ' Party record(s) but ' || v.n_union
             || ' different ones are claimed — not deciding; needs human review' AS reason
      FROM verdicts v JOIN claims c USING (doc) WHERE v.n_union > v.expected
      UNION ALL
      SELECT doc, 1, pos, value, 'party number ''' || value || ''' matches ' || n || ' records (' || names
             || ') with no exact key to break the tie — needs human review' FROM named)
    SELECT doc, string_agg(reason, '; ' ORDER BY phase, pos, value) AS reason FROM issues GROUP BY doc
    """


@query("reference_reasons", "WITH" + PARTIES + "," + RESOLVED + _REASONS)
def reference_reasons(t: Tables) -> DataFrame:
    settings = match_settings(SETTINGS)
    run = P.resolve_documents(references(t), parties(t), settings)
    targets = R.issue_targets(run.resolutions, run.hits)
    rows = R.issues(run.resolutions, run.consistency, targets, settings.rules, settings.target_doctype)
    return R.reasons(rows)


@query(
    "corroboration",
    "WITH" + PARTIES + "," + RESOLVED + """
    SELECT DISTINCT h.doc, h.name, true AS corroborated,
           EXISTS (SELECT 1 FROM hits x WHERE x.doc = h.doc AND x.name = h.name AND x.kind = 'account') AS strict
    FROM hits h
    """,
)
def corroboration(t: Tables) -> DataFrame:
    refs = references(t)
    cands = written(C.fetch_candidates(refs, parties(t), match_settings(SETTINGS).queries))
    hits = written(R.reference_hits(refs, cands, RULES))
    lenient = M.corroborated(cands, hits, RULES)
    strict = M.corroborated(cands, hits, RULES, for_gate=True).withColumnRenamed("corroborated", "strict")
    return lenient.join(strict, ["doc", "name"])


_SCORED = """
    , scored AS (
      SELECT doc, name,
             CASE WHEN max(CASE WHEN kind = 'account' THEN 1 ELSE 0 END) = 1 THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END AS confidence,
             coalesce(min(CASE WHEN kind = 'account' THEN value END), min_by(value, pos * 100000000 + length(value))) AS matched_value,
             CASE WHEN max(CASE WHEN kind = 'account' THEN 1 ELSE 0 END) = 1
                  THEN 'exact key matches the document''s account' ELSE 'name ends with the document''s tail' END AS reason
      FROM hits GROUP BY doc, name)
    """


@query(
    "scored_candidates",
    "WITH" + PARTIES + "," + RESOLVED + _SCORED + """
    SELECT s.doc, s.name, confidence, matched_value, reason, coalesce(p.since, '') AS rank_text
    FROM scored s JOIN parties p ON p.name = s.name
    """,
)
def scored_candidates(t: Tables) -> DataFrame:
    run = P.resolve_documents(references(t), parties(t), match_settings(SETTINGS))
    return run.scored.select("doc", "name", "confidence", "matched_value", "reason", "rank_text")


@query(
    "ranked_candidates",
    "WITH" + PARTIES + "," + RESOLVED + _SCORED + """
    , first AS (SELECT doc, name, min(CASE kind WHEN 'account' THEN 0 ELSE 1 END) AS query_ord FROM hits GROUP BY 1, 2)
    SELECT s.doc, s.name, confidence,
           row_number() OVER (PARTITION BY s.doc ORDER BY confidence DESC, coalesce(p.since, '') DESC, query_ord, s.name) AS rank
    FROM scored s JOIN parties p ON p.name = s.name JOIN first f ON f.doc = s.doc AND f.name = s.name
    """,
)
def ranked_candidates(t: Tables) -> DataFrame:
    settings = match_settings(SETTINGS)
    run = P.resolve_documents(references(t), parties(t), settings)
    return M.ranked_candidates(run.scored, settings.rank_desc).select("doc", "name", "confidence", "rank")


@query(
    "scored_with_context_rows",
    """
    WITH cands AS (SELECT o_orderkey AS doc, s_name AS name, s_suppkey, s_acctbal, o_custkey
                   FROM orders JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_nationkey = c_nationkey),
    marked AS (SELECT *, s_suppkey % 7 = o_custkey % 7 AND s_suppkey % 2 = 0 AS strong FROM cands),
    ranked AS (SELECT *, count(*) FILTER (strong) OVER (PARTITION BY doc) AS n_strong,
                      row_number() OVER (PARTITION BY doc, strong ORDER BY CAST(CAST(s_acctbal AS INTEGER) + 100000 AS VARCHAR) DESC, name) AS n
               FROM marked)
    SELECT doc, name, CASE WHEN strong THEN 0.95::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM ranked
    WHERE strong OR (n <= 3 AND n <= 5 - n_strong)
    """,
)
def scored_with_context_rows(t: Tables) -> DataFrame:
    """Rows without evidence: at most three, and only up to five rows in all."""
    docs = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("doc"), F.col("c_nationkey").alias("list")
    )
    kin = t.supplier.select(
        F.col("s_nationkey").alias("list"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 7).cast("string").alias("key"),
        (F.bround("s_acctbal").cast("int") + 100000).cast("string").alias("balance"),
        F.col("s_name").alias("fetch_pos"),
    )
    refs = t.orders.select(
        F.col("o_orderkey").alias("doc"), F.lit("account").alias("kind"), (F.col("o_custkey") % 7).cast("string").alias("value"), F.lit(0).alias("pos")
    )
    rules = R.rules_of([{"target_field": "key", "from": "account"}])
    scored = M.scored_by_lists(docs, kin, refs, rules, rank_field="balance", context_rows=3, limit=5)
    return scored.select("doc", "name", "confidence")


def document_windows(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("doc"),
        F.date_sub(F.col("o_orderdate").cast("date"), 1500).cast("string").alias("context_from"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate").cast("date").cast("string")).alias("context_to"),
    )


_GATE = """
    , gate AS (
      SELECT DISTINCT h.doc, h.name,
        (p.since IS NULL OR (p.since >= CAST(CAST(o.o_orderdate AS DATE) - 1500 AS VARCHAR)
          AND (o.o_orderpriority = '5-LOW' OR p.since <= CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR))
          OR o.o_orderkey IS NULL))
        AND NOT v.conflict
        AND NOT EXISTS (SELECT 1 FROM resolved r JOIN hits x ON x.doc = r.doc AND x.kind = r.kind AND x.value = r.value
                        WHERE r.status = 'ambiguous' AND r.doc = h.doc AND x.name = h.name)
        AND EXISTS (SELECT 1 FROM hits x WHERE x.doc = h.doc AND x.name = h.name AND x.kind = 'account') AS allowed
      FROM hits h JOIN parties p ON p.name = h.name JOIN verdicts v ON v.doc = h.doc
      LEFT JOIN orders o ON o.o_orderkey = h.doc)
    """


@query("write_gate", "WITH" + PARTIES + "," + RESOLVED + _GATE + "SELECT doc, name, allowed FROM gate")
def write_gate(t: Tables) -> DataFrame:
    return P.resolve_documents(references(t), parties(t), match_settings(SETTINGS), document_windows(t)).gate


_APPLIED = """
    , applied AS (
      SELECT s.doc, s.matched_value AS ref, min(s.name) AS target FROM scored s JOIN gate g ON g.doc = s.doc AND g.name = s.name
      WHERE g.allowed GROUP BY 1, 2 HAVING count(*) = 1)
    """


@query(
    "proof_resolution",
    "WITH" + PARTIES + "," + RESOLVED + _SCORED + _GATE + _APPLIED + "SELECT doc, ref, target FROM applied",
)
def proof_resolution(t: Tables) -> DataFrame:
    return P.resolve_documents(references(t), parties(t), match_settings(SETTINGS), document_windows(t)).applied


@query(
    "proof_coverage",
    "WITH" + PARTIES + "," + RESOLVED + _SCORED + _GATE + _APPLIED + """
    SELECT r.doc, count(*) AS n_refs, count(a.ref) AS n_applied, count(*) = count(a.ref) AS resolved
    FROM (SELECT DISTINCT doc, value FROM refs) r LEFT JOIN applied a ON a.doc = r.doc AND a.ref = r.value GROUP BY r.doc
    """,
)
def proof_coverage(t: Tables) -> DataFrame:
    return P.resolve_documents(references(t), parties(t), match_settings(SETTINGS), document_windows(t)).coverage


def answers(t: Tables) -> DataFrame:
    """Model answers: each line names the customer numbered like its part."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("doc"),
        (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey")).alias("pos"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("target"),
        (F.col("l_discount") * 15 - F.lit(0.05)).alias("confidence"),
        F.col("l_returnflag").alias("reason"),
    )


_ANSWERS = """
    , kept AS (
      SELECT doc, target, max(least(greatest(c, 0), 1)) AS confidence FROM (
        SELECT l_orderkey AS doc, 'Customer#' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS target, l_discount * 15 - 0.05 AS c
        FROM lineitem) a
      WHERE EXISTS (SELECT 1 FROM hits h WHERE h.doc = a.doc AND h.name = a.target) GROUP BY 1, 2),
    judged AS (
      SELECT d.doc, coalesce(max(k.confidence), 0) AS best,
             CASE WHEN max(k.confidence) IS NULL THEN 'none' WHEN max(k.confidence) >= 0.8 THEN 'matched' ELSE 'doubt' END AS status
      FROM (SELECT DISTINCT doc FROM hits) d LEFT JOIN kept k ON k.doc = d.doc GROUP BY d.doc)
    """


@query(
    "validated_answers",
    "WITH" + PARTIES + "," + RESOLVED + _ANSWERS + "SELECT doc, target, round(confidence, 6) AS confidence FROM kept",
)
def validated_answers(t: Tables) -> DataFrame:
    cands = C.fetch_candidates(references(t), parties(t), match_settings(SETTINGS).queries)
    kept, _ = M.validate_answers(answers(t), cands)
    return kept.select("doc", "target", F.round("confidence", 6).alias("confidence"))


def _verdict(t: Tables) -> tuple[DataFrame, DataFrame]:
    settings = match_settings(SETTINGS)
    run = P.resolve_documents(references(t), parties(t), settings)
    kept, judged = M.validate_answers(answers(t), run.candidates, settings.threshold)
    linked = M.corroborated(run.candidates, run.hits, settings.rules)
    tied = R.issue_targets(run.resolutions, run.hits).where(F.col("type") == "ambiguous")
    return M.match_verdict(kept, judged, linked, run.resolutions, run.consistency, tied)


@query(
    "match_verdict",
    "WITH" + PARTIES + "," + RESOLVED + _ANSWERS + """
    SELECT j.doc, CASE
        WHEN v.conflict OR (EXISTS (SELECT 1 FROM resolved r WHERE r.doc = j.doc AND r.status = 'exact')
             AND EXISTS (SELECT 1 FROM kept k WHERE k.doc = j.doc AND NOT EXISTS (
                         SELECT 1 FROM resolved r WHERE r.doc = k.doc AND r.target = k.target))) THEN 'conflict'
        WHEN j.status = 'matched' AND EXISTS (
             SELECT 1 FROM kept k JOIN hits h ON h.doc = k.doc AND h.name = k.target
             JOIN resolved r ON r.doc = h.doc AND r.kind = h.kind AND r.value = h.value AND r.status = 'ambiguous'
             WHERE k.doc = j.doc) THEN 'doubt'
        ELSE j.status END AS status
    FROM judged j LEFT JOIN verdicts v ON v.doc = j.doc
    """,
)
def match_verdict(t: Tables) -> DataFrame:
    return _verdict(t)[1].select("doc", "status")


@query(
    "match_results",
    "WITH" + PARTIES + "," + RESOLVED + _ANSWERS + """
    SELECT doc, target, round(confidence, 6) AS confidence, false AS proof FROM kept
    UNION ALL
    SELECT doc, target, 0.95::DOUBLE, true FROM resolved r WHERE status = 'exact'
      AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc = r.doc AND k.target = r.target)
    """,
)
def match_results(t: Tables) -> DataFrame:
    return _verdict(t)[0].select("doc", "target", F.round("confidence", 6).alias("confidence"), "proof")


@query(
    "cross_check",
    """
    SELECT l_orderkey AS doc, l_linenumber AS idx, CAST(l_partkey AS VARCHAR) AS value,
           CASE WHEN EXISTS (
             SELECT 1 FROM customer WHERE c_custkey = l_partkey AND (l_returnflag = 'A' OR c_mktsegment =
               CASE l_returnflag WHEN 'R' THEN 'BUILDING' ELSE 'FURNITURE' END)) THEN 'matched' ELSE 'miss' END AS cross_check
    FROM lineitem
    """,
)
def cross_check(t: Tables) -> DataFrame:
    """Parts looked up among customers of the segment the document names; a
    document that names none looks among all."""
    doc = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lines = t.lineitem.withColumn("doc", doc)
    items = lines.select(
        "doc", "l_orderkey", F.lit("bill").alias("key"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").cast("string").alias("value")
    )
    segment = F.when(F.col("l_returnflag") == "R", "BUILDING").when(F.col("l_returnflag") == "N", "FURNITURE").otherwise("")
    context = lines.select("doc", segment.alias("segment")).distinct()
    checked = Q.cross_check(items, t.customer, "bill", "c_custkey", "Customer", context, {"c_mktsegment": "segment"})
    number = F.split("doc", "[|]")[0].cast("bigint")
    return checked.select(number.alias("doc"), "idx", "value", "cross_check")


def mappings(t: Tables) -> DataFrame:
    """Learned mappings: a supplier's parts by name, the part's size as code."""
    known = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("hit_count"), F.max("l_shipdate").alias("last_used"))
    return known.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_suppkey", "l_partkey").alias("name"),
        F.col("l_suppkey").cast("string").alias("supplier"),
        F.lit("Ledger").alias("source_system"),
        F.lit("Purchase Invoice").alias("target_doctype"),
        F.col("l_partkey").alias("item_code"),
        F.col("p_name").alias("printed_text"),
        F.col("p_name").alias("normalized_text"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).alias("supplier_code"),
        F.col("p_type").alias("uom"),
        F.col("hit_count").cast("bigint").alias("hit_count"),
        F.lit(1.0).alias("confidence"),
        "last_used",
    )


_MAPPINGS = """
    maps AS (
      SELECT l_suppkey AS supplier, l_partkey AS item_code, p_name AS normalized_text,
             CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS code, p_type AS uom, count(*) AS hits,
             l_suppkey || '-' || l_partkey AS name, max(l_shipdate) AS last_used
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, l_partkey, p_name, p_size, p_type)
    """


@query(
    "memory_lookup",
    "WITH" + _MAPPINGS + """
    , code_top AS (SELECT supplier, code, arg_max(item_code, (hits, name)) AS item, arg_max(uom, (hits, name)) AS uom
                   FROM maps WHERE code IS NOT NULL GROUP BY 1, 2),
    text_top AS (SELECT supplier, normalized_text, arg_max(item_code, (hits, name)) AS item, arg_max(uom, (hits, name)) AS uom
                 FROM maps GROUP BY 1, 2),
    lines AS (SELECT s_suppkey AS supplier, p_partkey AS asked, p_name AS text, CAST(p_size AS VARCHAR) AS code
              FROM part JOIN supplier ON s_suppkey = p_partkey % 100)
    SELECT l.supplier, l.asked, coalesce(c.item, t.item) AS item_code, CASE WHEN c.item IS NOT NULL THEN c.uom ELSE t.uom END AS item_uom,
           CASE WHEN c.item IS NOT NULL THEN 'code' WHEN t.item IS NOT NULL THEN 'text' END AS tier
    FROM lines l
    LEFT JOIN code_top c ON c.supplier = l.supplier AND c.code = l.code AND c.item % 3 <> 0
    LEFT JOIN text_top t ON t.supplier = l.supplier AND t.normalized_text = l.text AND t.item % 3 <> 0
    """,
)
def memory_lookup(t: Tables) -> DataFrame:
    """Every third item is gone: a dead best mapping falls to the text tier."""
    return _lookup(t, F.col("p_partkey") % 100)


@query(
    "memory_lookup_whole",
    ORACLE["memory_lookup"].replace("s_suppkey = p_partkey % 100", "s_suppkey = p_partkey % (SELECT count(*) FROM supplier)"),
)
def memory_lookup_whole(t: Tables) -> DataFrame:
    """The same with a line of every part, over all suppliers."""
    return _lookup(t, F.col("p_partkey") % t.supplier.count())


def _lookup(t: Tables, supplier: Column) -> DataFrame:
    lines = t.part.join(t.supplier, F.col("s_suppkey") == supplier).select(
        F.col("s_suppkey").cast("string").alias("supplier"),
        F.lit("Ledger").alias("source_system"),
        F.lit("Purchase Invoice").alias("target_doctype"),
        F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("text"),
        F.col("p_size").cast("string").alias("code"),
        F.col("p_partkey").alias("asked"),
    )
    items = t.part.where(F.col("p_partkey") % 3 != 0).select(F.col("p_partkey").alias("item_code"))
    found = L.lookup_mappings(lines, mappings(t), items)
    return found.select(F.col("supplier").cast("bigint").alias("supplier"), "asked", "item_code", "item_uom", "tier")


@query(
    "memory_upsert",
    "WITH" + _MAPPINGS + """
    , fresh AS (
      SELECT s_suppkey AS supplier, p_partkey AS item_code, p_name AS normalized_text, 'C' || l_linenumber AS code, 'new' AS uom, l_shipdate AS used
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = (l_suppkey + l_linenumber) % 100
      WHERE s_suppkey <> 7),
    every AS (
      SELECT supplier, item_code, normalized_text, code, uom, hits, last_used AS used, 0 AS fresh FROM maps
      UNION ALL SELECT supplier, item_code, normalized_text, code, uom, 1, used, 1 FROM fresh)
    SELECT supplier, item_code, CAST(sum(hits) AS BIGINT) AS hit_count, max(used) AS last_used,
           arg_min(code, (fresh, used, code)) FILTER (code IS NOT NULL) AS supplier_code, arg_min(uom, fresh) AS uom
    FROM every GROUP BY supplier, item_code, normalized_text
    """,
)
def memory_upsert(t: Tables) -> DataFrame:
    """Confirmations: each line's part confirmed for a neighbouring supplier;
    those without a supplier are ignored."""
    return _upsert(t, (F.col("l_suppkey") + F.col("l_linenumber")) % 100)


@query(
    "memory_upsert_whole",
    ORACLE["memory_upsert"].replace(
        "s_suppkey = (l_suppkey + l_linenumber) % 100",
        "s_suppkey = (l_suppkey + l_linenumber) % (SELECT count(*) FROM supplier)",
    ),
)
def memory_upsert_whole(t: Tables) -> DataFrame:
    """The same with every line, over all suppliers."""
    return _upsert(t, (F.col("l_suppkey") + F.col("l_linenumber")) % t.supplier.count())


def _upsert(t: Tables, supplier: Column) -> DataFrame:
    lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    known = t.supplier.select(F.col("s_suppkey").alias("_s"))
    fresh = lines.withColumn("_s", supplier).join(known, "_s", "left_semi").select(
        F.when(F.col("_s") != 7, F.col("_s").cast("string")).alias("supplier"),
        F.lit("Ledger").alias("source_system"),
        F.lit("Purchase Invoice").alias("target_doctype"),
        F.col("l_partkey").alias("item_code"),
        F.upper("p_name").alias("printed_text"),
        F.concat(F.lit("C"), "l_linenumber").alias("code"),
        F.lit("new").alias("uom"),
        F.col("l_shipdate").alias("at"),
    )
    return L.upsert_mappings(mappings(t), fresh).select(
        F.col("supplier").cast("bigint").alias("supplier"), "item_code", "hit_count", "last_used", "supplier_code", "uom"
    )


@query(
    "stale_vectors",
    """
    SELECT d.doc_id AS item, sha1(d.text) AS text_hash FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    WHERE l.doc_id IS NULL OR l.quality = 0 OR l.toxic = 1
    """,
)
def stale_vectors(t: Tables) -> DataFrame:
    """Labelled documents have a vector: of the right text if the quality is
    good, empty if toxic."""
    texts = t.documents.select(F.col("doc_id").alias("item"), "text")
    stored = t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").alias("item"),
        F.when(F.col("quality") == 1, F.sha1("text")).otherwise("other").alias("text_hash"),
        (F.col("toxic") == 0).alias("has_vector"),
    )
    return L.stale_vectors(texts, stored, F.col("text"))


@query(
    "semantic_topk",
    """
    WITH q AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
    scored AS (SELECT q.label AS query, e.vec_id AS item,
                      round(list_cosine_similarity(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 3) AS score
               FROM q, embeddings e)
    SELECT query, item, score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS INTEGER) AS rank FROM scored) r
    WHERE rank <= 8
    """,
)
def semantic_topk(t: Tables) -> DataFrame:
    """The first vector of each label against all items."""
    queries = t.embeddings.groupBy(F.col("label").alias("query")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    items = t.embeddings.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    return S.rank_items(queries, items)
