"""What must not grow faster than the input: tables written, pieces looked up, pairs met."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from papertally.catalog.quality import receipt_items
from papertally.catalog.registry import Tables
from papertally.functions.boxes import BOX_TYPE
from papertally.functions.ratio import within_edits
from papertally.functions.replies import parse_reply
from papertally.operators import candidates as C
from papertally.operators import extraction as X
from papertally.operators import locate as LO
from papertally.operators import matching as M
from papertally.operators import quality as Q
from papertally.operators import references as R


def test_places_are_found_without_written_tables(spark, monkeypatch):
    def refuse(df):
        raise AssertionError("a table is written")

    monkeypatch.setattr(LO, "written", refuse, raising=False)
    words = [(p, "1", w, (0.1 * i, 0.1, 0.09, 0.02)) for p in (1, 2) for i, w in enumerate(("one", "INV-204", "two", "INV-2O4"))]
    table = spark.createDataFrame([*words, (1, None, "INV-204", (0.1, 0.5, 0.09, 0.02))], f"page int, line string, text string, bbox {BOX_TYPE}")
    targets = spark.createDataFrame([(1, "t", ["INV-204"]), (2, "t", ["nothing"])], "page int, target string, forms array<string>")
    found = LO.top_clusters(LO.scored_windows(table, targets)).where("rank <= 2").orderBy("rank").collect()
    assert [(r.page, r.rank, r.score, r.text) for r in found] == [(1, 1, 1.0, "INV-204"), (1, 2, 0.8333, "INV-2O4")]


def test_edit_bound_never_drops_a_pair_that_reaches_the_floor(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abc", k=rng.randint(1, 12))), "".join(rng.choices("abc", k=rng.randint(1, 12)))) for _ in range(2000)]
    alike = [p for p in pairs if SequenceMatcher(None, *p).ratio() >= LO.MATCH_FLOOR]
    table = spark.createDataFrame(pairs, "a string, b string")
    kept = {tuple(r) for r in table.where(within_edits(F.col("a"), F.col("b"), LO.MATCH_FLOOR)).collect()}
    assert len(alike) > 50 and set(alike) <= kept < set(pairs)


def test_long_numbers_are_looked_up_by_long_pieces(spark, monkeypatch):
    sizes, real = [], C.written

    def counted(df):
        table = real(df)
        if "_key" in table.columns:
            sizes.append(table.count())
        return table

    monkeypatch.setattr(C, "written", counted)
    target = spark.range(1000).select(F.col("id").alias("name"), F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("text"))
    asked = spark.createDataFrame([("%#000000123",), ("%#000000456",), ("%9%9%",)], "pattern string")
    hits = {(r.pattern, r.name) for r in C.pattern_hits(asked.limit(2), target, "text").collect()}
    assert hits == {("%#000000123", 123), ("%#000000456", 456)}
    assert sum(sizes) < 1000
    twice = {r.name for r in C.pattern_hits(asked.where("pattern = '%9%9%'"), target, "text").collect()}
    assert twice == {n for n in range(1000) if f"{n:09d}".count("9") >= 2}


def test_documents_with_the_same_lists_are_scored_once(spark, monkeypatch):
    rules = R.rules_of([{"target_field": "key", "from": "account"}])
    lists = [(c, f"n{c}{i}", str(i % 3), str(i), f"n{c}{i}") for c in "ab" for i in range(8)] + [("a", "na1", "1", "1", "na1"), ("a", None, "1", "9", "x")]
    docs = [(d, "ab"[d % 2]) for d in range(40)] + [(3, "b"), (4, "b"), (None, "a"), (None, "b"), (50, None), (51, "none")]
    refs = [(d, "account", str(d % 2), 0) for d in range(40)] + [(5, "account", "2", 1), (6, "other", "1", 0), (7, "account", None, 0), (None, "account", "1", 0)]
    docs = spark.createDataFrame(docs, "doc int, list string")
    lists = spark.createDataFrame(lists, "list string, name string, key string, balance string, fetch_pos string")
    refs = spark.createDataFrame(refs, "doc int, kind string, value string, pos int")
    options = {"rank_field": "balance", "context_rows": 3, "limit": 5}
    cands = docs.join(lists, "list").drop("list")
    want = M.scored_candidates(cands, R.reference_hits(refs, cands, rules), rules, **options)
    seen, real = [], M.scored_candidates

    def counted(cands, *args, **kwargs):
        seen.append(cands.count())
        return real(cands, *args, **kwargs)

    monkeypatch.setattr(M, "scored_candidates", counted)
    got = M.scored_by_lists(docs, lists, refs, rules, **options)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert seen[0] < cands.count() / 2


def _contains_case(spark):
    rng = random.Random(11)
    names = [f"C{i:03d}" for i in range(120)]
    target = spark.createDataFrame([(n, n[1:], f"{n}/{i % 7}") for i, n in enumerate(names)], "name string, key string, text string")
    refs = [(d, "account", f"{rng.randrange(150):03d}", 0) for d in range(60)]
    refs += [(d, "tail", str(rng.randrange(30)), 0) for d in range(60) for _ in range(rng.randint(0, 3))]
    refs += [(7, "tail", "_", 0), (8, "tail", None, 0), (None, "tail", "11", 0), (None, "account", "011", 0), (9, "tail", "0", 0), (9, "account", "001", 0)]
    frame = spark.createDataFrame([*refs, *refs[:20]], "doc int, kind string, value string, pos int")
    queries = [{"keys": [{"field": "key", "from": "account"}]}, {"keys": [{"field": "text", "from": "tail", "match": "contains"}, {"field": "key", "from": "account"}]}]
    want = {}
    for d, kind, value, _ in refs:
        for i, n in enumerate(names):
            if kind == "account" and value == n[1:]:
                want[d, n] = 0
            elif kind == "tail" and value not in (None, "_") and value in f"{n}/{i % 7}":
                want[d, n] = min(want.get((d, n), 1), 1)
    return frame, target, queries, want


def test_documents_of_the_same_values_fetch_a_list_once(spark, monkeypatch):
    refs, target, queries, want = _contains_case(spark)

    def refuse(*args):
        raise AssertionError("rows of documents are put in order one by one")

    monkeypatch.setattr(C, "union_first", refuse)
    got = C.fetch_candidates(refs, target, queries)
    assert got.columns == ["doc", *target.columns, "fetch_pos", "query_ord"]
    rows = got.select("doc", "name", "query_ord").collect()
    assert {(r.doc, r.name): r.query_ord for r in rows} == want and len(rows) == len(want)


def test_documents_beyond_the_limits_of_lists_are_whole(spark, monkeypatch):
    refs, target, queries, want = _contains_case(spark)
    for few, shared in ((2, 0), (0, 0), (64, 0)):
        monkeypatch.setattr(C, "LIST_LIMIT", few)
        monkeypatch.setattr(C, "SKIP_LIMIT", shared)
        rows = C.fetch_candidates(refs, target, queries).select("doc", "name", "query_ord").collect()
        assert {(r.doc, r.name): r.query_ord for r in rows} == want and len(rows) == len(want)


LINE = "doc long, `table` string, row_no int, description string, raw_json string, resolution_status string, matched_item string"


def test_cells_of_child_rows_are_made_once(spark):
    """Lines may share their place or have none: an ``item_name`` given in one of
    them keeps the description of the other away, unless the document is null."""
    rows = [
        (1, "items", 1, "d1", '{"qty": "2", "page": 3, "item_name": "own", "colour": "red"}', "Confirmed", None),
        (1, "items", 1, "d2", '{"qty": "4"}', None, None),
        (1, "items", 2, "d3", '{"qty": "", "item_name": " "}', "Confirmed", "I2"),
        (1, "items", 3, "d4", None, "Free Text", "I3"),
        (1, "items", 4, "d5", '{"qty": "5"}', "Rejected", "I4"),
        (1, "other", 5, "d6", '{"qty": "6"}', "Confirmed", "I5"),
        (2, "items", 6, "", "{}", "Confirmed", None),
        (None, "items", 7, "d7", '{"item_name": "n"}', "Confirmed", None),
        (1, "elsewhere", 8, "d8", '{"qty": "7"}', "Confirmed", "I8"),
        (1, "", 9, "d9", '{"qty": "7"}', "Confirmed", "I9"),
    ]
    columns = [("items", "qty", "Float"), ("items", "item_name", "Data"), ("items", "item_code", "Link"), ("other", "qty", "Int")]
    cells = X.build_child_rows(
        spark.createDataFrame(rows, LINE),
        spark.createDataFrame(columns, "`table` string, `column` string, fieldtype string"),
        spark.createDataFrame([("items", "item_code")], "`table` string, link_field string"),
    )
    assert "from_json" not in cells._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, cells.collect()), key=str) == sorted(
        [
            (1, "items", 1, "qty", "2.0"),
            (1, "items", 1, "item_name", "own"),
            (1, "items", 1, "qty", "4.0"),
            (1, "items", 2, "item_code", "I2"),
            (1, "items", 3, "item_name", "d4"),
            (1, "other", 5, "qty", "6"),
            (None, "items", 7, "item_name", "n"),
            (None, "items", 7, "item_name", "d7"),
        ],
        key=str,
    )


def test_objects_are_told_without_their_schema(spark):
    texts = ['{"fields": [{"fieldname": "a", "value": 1}, 7, null, {}], "lines": [{"qty": 1}, [], "x", {}]}', '{"tables": {"items": [{"qty": 2}]}}']
    texts += ['{"tables": [], "lines": [{"qty": 3}]}', '{"tables": null, "fields": {"a": {"value": 2}, "b": 3}}', "[]", None]
    replies = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    parsed = replies.select("doc", parse_reply(F.concat(F.lit(" \t\n\x0b"), "text", F.lit("\r\n"))).alias("reply"))
    fields, lines = X.reply_fields(parsed), X.line_rows(parsed, ["items"])
    for df in (fields, lines):
        assert "schema_of_variant" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc, r.fieldname, r.pos) for r in fields.collect()) == [(0, "a", 0), (3, "a", 0)]
    assert sorted((r.doc, r.row_no, r.qty) for r in lines.collect()) == [(0, 1, 1.0), (0, 2, 0.0), (1, 1, 2.0), (2, 1, 3.0)]


def _longest_methods(df) -> list[int]:
    debug = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution, "debug"), "package$")
    parts = getattr(debug, "MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]


def test_items_are_made_by_methods_the_jvm_compiles(spark, tmp_path):
    # the JVM leaves methods of more than 8,000 bytes uncompiled
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.sql(
        "SELECT 1L AS o_orderkey, 2L AS o_custkey, 'O' AS o_orderstatus, 3.5D AS o_totalprice, "
        "TIMESTAMP'1996-01-02 00:00:00' AS o_orderdate, '5-LOW' AS o_orderpriority"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 1L AS l_orderkey, 1 AS l_linenumber, 7L AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    items = receipt_items(Tables(spark, str(tmp_path)))
    assert {(r.doc, r.key, r.value) for r in items.collect()} >= {(1, "lr_number", " TND1 "), (1, "bill_numbers", "B-7")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert 0 < max(_longest_methods(items.select("*"))) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_a_box_looks_for_partners_in_few_places(spark):
    rng = random.Random(5)
    boxes = [(rng.random() * 0.8, 4 ** -(1 + 3 * rng.random())) for _ in range(2000)]
    table = spark.createDataFrame(boxes, "edge double, side double")
    places = table.select(F.explode(Q._places(F.col("edge"), F.col("side"))).alias("p")).where("p IS NOT NULL").count()
    # two axes: this is to be squared
    assert len(boxes) <= places < 2 * len(boxes)


def test_missing_keys_of_a_long_schema(spark):
    keys = [f"k{i}" for i in range(130)]
    items = spark.createDataFrame([(1, k) for k in keys if k not in ("k0", "k61", "k62", "k129")] + [(2, "other"), (None, "k5")], "doc int, key string")
    docs = spark.createDataFrame([(1,), (2,), (None,)], "doc int")
    got = {(r.doc, r.key) for r in Q._lacking(docs, items, keys).collect()}
    assert {k for d, k in got if d == 1} == {"k0", "k61", "k62", "k129"}
    assert {k for d, k in got if d == 2} == set(keys) == {k for d, k in got if d is None}
    assert "ObjectHashAggregate" not in Q._lacking(docs, items, keys)._jdf.queryExecution().toString()


def test_evidence_and_resolutions_move_only_what_they_compare(spark):
    rules = R.rules_of([
        {"target_field": "key", "from": "account"}, {"target_field": "alias", "from": "account", "score": 0.9},
        {"target_field": "name", "from": "tail", "match": "numeric_suffix"}, {"target_field": "code", "from": "tail", "match": "numeric_suffix", "score": 0.8},
        {"target_field": "note", "from": "tail", "match": "numeric_suffix", "score": 0.3},
    ])
    rng = random.Random(7)
    refs = {(rng.randint(1, 9), kind, f"v{n}"): n for kind in ("account", "tail") for n in range(40)}
    rows = {(*ref, pos, None, None, None) for ref, pos in refs.items()}
    for (doc, kind, value), pos in refs.items():
        for name in rng.sample("abcdef", rng.randint(0, 2)):
            ord_ = rng.choice([0, 1] if kind == "account" else [2, 3, 4])
            rows.add((doc, kind, value, pos, rules[ord_].mode, name, ord_))
    hits = spark.createDataFrame(list(rows), "doc int, kind string, value string, pos int, mode string, name string, rule_ord int")

    scores = [r.score or (M.EXACT_SCORE if r.mode == "exact" else M.SUFFIX_SCORE) for r in rules]
    wanted = {}
    for doc, kind, value, pos, mode, name, o in rows:
        if name and (mode == "exact" or scores[o] > M.BASE_SCORE):
            order = (mode != "exact", 0 if mode == "exact" else -scores[o], o, pos, value)
            wanted[doc, name] = min(wanted.get((doc, name), order), order)
    # the kind of a hit is that of its rule and isn't shuffled beside it
    found = {(r.doc, r.name): r for r in M.evidence(hits.drop("kind"), rules).collect()}
    assert found.keys() == wanted.keys()
    for at, (_, _, o, _, value) in wanted.items():
        r = found[at]
        assert (r.confidence, r.matched_value, r.via, r.kind, r.mode) == (scores[o], value, rules[o].target_field, rules[o].source, rules[o].mode)

    named = {ref: {m: {n for *r, _, mode, n, _ in rows if tuple(r) == ref and mode == m} for m in ("exact", "suffix")} for ref in refs}
    proven = {(ref[0], n) for ref, of in named.items() if len(of["exact"]) == 1 for n in of["exact"]}
    resolved = R.resolve_references(hits, rules)
    got = {(r.doc, r.kind, r.value): (r.n_exact, r.n_suffix, r.status, r.target, r.pos) for r in resolved.collect()}
    for ref, of in named.items():
        paired = {n for n in of["suffix"] if (ref[0], n) in proven}
        exact, suffix = len(of["exact"]), len(of["suffix"])
        status = "exact" if exact == 1 else "duplicate" if exact else "paired" if len(paired) == 1 else ["unresolved", "suffix", "ambiguous"][min(suffix, 2)]
        chosen = {"exact": of["exact"], "paired": paired, "suffix": of["suffix"]}.get(status)
        assert got.pop(ref) == (exact, suffix, status, min(chosen) if chosen else None, refs[ref])
    assert not got


def test_documents_of_a_kind_stand_together(spark):
    docs = spark.range(300).select(F.col("id").alias("doc"), F.when(F.xxhash64("id") % 2 == 0, "x").otherwise("y").alias("list"))
    refs = docs.select("doc", F.lit("account").alias("kind"), F.lit("k").alias("value"), F.lit(0).alias("pos"))
    lists = spark.createDataFrame([("x", "a", "k", 0), ("y", "b", "k", 0)], "list string, name string, key string, fetch_pos int")
    rules = R.rules_of([{"target_field": "key", "from": "account"}])
    rows = M.scored_by_lists(docs, lists, refs, rules).select("doc", "name").collect()
    assert len(rows) == 300 and sum(a.name != b.name for a, b in zip(rows, rows[1:])) <= 16


def test_documents_of_a_list_stand_together(spark):
    value = F.when(F.xxhash64("id") % 2 == 0, "x1").otherwise("y2")
    refs = spark.range(300).select(F.col("id").alias("doc"), F.lit("tail").alias("kind"), value.alias("value"), F.lit(0).alias("pos"))
    target = spark.createDataFrame([("a", "k", "zzx1zz"), ("b", "l", "zzy2zz")], "name string, key string, text string")
    queries = [{"keys": [{"field": "key", "from": "account"}]}, {"keys": [{"field": "text", "from": "tail", "match": "contains"}]}]
    rows = C.fetch_candidates(refs, target, queries).select("doc", "name").collect()
    assert len(rows) == 300 and sum(a.name != b.name for a, b in zip(rows, rows[1:])) <= 16
