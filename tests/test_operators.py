"""Checks against brute force and against the literal cases."""

from __future__ import annotations

from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from papertally.functions.boxes import BOX_TYPE
from papertally.operators import candidates as C
from papertally.operators import locate as LO
from papertally.operators import pages as G
from papertally.operators import perms as PM
from papertally.operators import quality as Q
from papertally.operators import semantic as S
from papertally.operators.filters import DocumentValues, resolve, table_scan
from papertally.plans import plugins as PL
from papertally.plans.settings import output_schema

WORD = f"page int, line string, text string, bbox {BOX_TYPE}"


def iou(a, b):
    ix = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    iy = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - ix * iy
    return ix * iy / union if union > 0 else 0.0


def test_collisions_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    boxes = []
    for i in range(400):
        base = rng.choice([(0.1, 0.1, 0.2, 0.05), (0.5, 0.5, 0.03, 0.4), (0.2, 0.7, 0.5, 0.2)])
        boxes.append((i, tuple(round(v * rng.uniform(0.9, 1.1), 4) for v in base)))
    rows = [("d", f"k{i % 7}", i, b) for i, b in boxes]
    items = spark.createDataFrame(rows, f"doc string, key string, idx int, bbox {BOX_TYPE}")
    schema = [Q.FieldSpec(f"k{i}", kind="array") for i in range(7)]
    got = {(r.key, r.idx, r.other_key, r.other_idx) for r in Q.colliding_pairs(items, schema).collect()}
    expected = set()
    for i, a in boxes:
        for j, b in boxes:
            if (i % 7, i) < (j % 7, j) and i % 7 != j % 7 and iou(a, b) >= 0.85:
                expected.add((f"k{i % 7}", i, f"k{j % 7}", j))
    assert got == expected and len(expected) > 100


def word(text, x, y, w=0.12, h=0.02, line="1", page=1):
    return (page, line, text, (x, y, w, h))


def clusters(spark, words, *forms):
    targets = spark.createDataFrame([(1, "t", list(forms))], "page int, target string, forms array<string>")
    return LO.top_clusters(LO.scored_windows(spark.createDataFrame(words, WORD), targets))


def test_locating(spark):
    one = [word("LR", 0.10, 0.10, 0.04), word("No:", 0.15, 0.10, 0.04), word("TND-2493", 0.30, 0.10)]
    found = clusters(spark, one, "TND - 2493", "TND-2493")
    first = found.orderBy("rank").first()
    assert first.score == 1.0 and tuple(first.bbox)[:2] == (0.3, 0.1)
    assert LO.certain_location(found).count() == 1
    twice = clusters(spark, [*one, word("TND-2493", 0.30, 0.50, line="2")], "TND-2493")
    assert twice.where("score = 1").count() == 2 and LO.certain_location(twice).count() == 0
    assert clusters(spark, [word("5541", 0.5, 0.5)], "554").count() == 0
    assert clusters(spark, [word("554", 0.5, 0.5)], "554").first().score == 1.0
    fuzzy = clusters(spark, [word("TND-24S3", 0.3, 0.3)], "TND-2493")
    assert 0.72 <= fuzzy.first().score < 0.92 and LO.certain_location(fuzzy).count() == 0
    parts = [word("GR", 0.10, 0.2, 0.03), word("12", 0.14, 0.2, 0.03), word("345", 0.18, 0.2, 0.04)]
    joined = clusters(spark, parts, "GR 12 345").first()
    assert joined.score == 1.0 and joined.bbox.x == 0.1 and round(joined.bbox.w, 3) == 0.12


def brute_force_clusters(words, form):
    """All windows of all lines, scored and suppressed one after the other."""
    norm = lambda s: "".join(ch for ch in s.lower() if ch.isascii() and ch.isalnum())
    want, found = norm(form), []
    for line in sorted({w[1] for w in words}):
        ws = sorted((w for w in words if w[1] == line), key=lambda w: w[3][0])
        for i in range(len(ws)):
            for j in range(i, min(i + 6, len(ws))):
                joined = "".join(norm(w[2]) for w in ws[i : j + 1])
                if not joined or len(joined) > len(want) * 1.4 + 2:
                    continue
                score = 1.0 if joined == want else SequenceMatcher(None, joined, want).ratio() if len(want) >= 4 else 0.0
                if score >= 0.72:
                    bs = [w[3] for w in ws[i : j + 1]]
                    x0, y0 = min(b[0] for b in bs), min(b[1] for b in bs)
                    x1, y1 = max(b[0] + b[2] for b in bs), max(b[1] + b[3] for b in bs)
                    found.append((-round(score, 4), line, i, j, (x0, y0, round(x1 - x0, 4), round(y1 - y0, 4))))
    kept = []
    for c in sorted(found):
        if all(iou(c[4], k[4]) < 0.5 for k in kept):
            kept.append(c)
    return [(-c[0], round(c[4][0], 4), round(c[4][1], 4)) for c in kept[:8]]


def test_locating_equals_brute_force(spark):
    import random

    rng = random.Random(11)
    stock = ["alpha", "alpah", "alp", "ha", "beta", "gamma", "al", "pha-9", "x"]
    words = [word(rng.choice(stock), round(0.01 * n, 4), round(0.03 * ln, 4), 0.009, 0.02, line=f"{ln:02d}") for ln in range(12) for n in range(30)]
    for form in ("alpha", "alpha beta", "beta9", "al"):
        rows = clusters(spark, words, form).orderBy("rank").collect()
        got = [(r.score, r.bbox.x, r.bbox.y) for r in rows]
        assert got == brute_force_clusters(words, form)


def test_clusters_of_many_boxes_and_of_one_without_area(spark):
    rows = [(1, "t", "1", i, 1, "w", (0.1 + 0.0001 * i, 0.1, 0.2, 0.1), 0.9 - i * 0.001) for i in range(30)]
    rows += [(1, "t", "2", 100 + i, 1, "w", (0.1, 0.3 + 0.15 * i, 0.1, 0.1), 0.8) for i in range(3)]
    rows += [(1, "t", "3", 1, 1, "w", (0.9, 0.9, 0.0, 0.0), 0.75), (2, "t", "1", 1, 1, "w", None, 0.9)]
    scored = spark.createDataFrame(rows, f"page int, target string, line string, start int, width int, text string, bbox {BOX_TYPE}, score double")
    found = LO.top_clusters(scored).orderBy("rank").collect()
    assert [(r.page, r.rank, round(r.bbox.y, 2)) for r in found] == [(1, 1, 0.1), (1, 2, 0.3), (1, 3, 0.45), (1, 4, 0.6), (1, 5, 0.9)]
    assert LO.top_clusters(scored.limit(0)).count() == 0


def test_tightening(spark):
    found = clusters(spark, [word("TND-2493", 0.30, 0.10)], "TND-2493")
    near, far = (0.28, 0.13, 0.2, 0.03), (0.28, 0.6, 0.2, 0.03)
    for claimed, expected in ((near, True), (far, False), (None, False), ((0.3, 0.1, 0.12, 0.02), False)):
        items = spark.createDataFrame([(1, "t", claimed)], f"page int, target string, bbox {BOX_TYPE}")
        assert LO.tighten_boxes(items, found).first().snapped is expected
    rejected = spark.createDataFrame([(1, "t", (0.3, 0.1, 0.12, 0.02))], f"page int, target string, bbox {BOX_TYPE}")
    items = spark.createDataFrame([(1, "t", near)], f"page int, target string, bbox {BOX_TYPE}")
    assert LO.tighten_boxes(items, found, rejected).first().snapped is False


def test_label_snapping_equals_closest_match(spark):
    labels = ["Invoice", "invoices", "Lorry Receipt", "Way Bill"]
    asked = ["INVOICE", "Invoce", "Lory Receipt", "lorry receipt ", "nothing", "", "unknown", "Way Bil", "nvoices"]
    rows = spark.createDataFrame([(i, "L", a) for i, a in enumerate(asked)], "i int, layout string, section string")
    known = spark.createDataFrame([("L", i, x) for i, x in enumerate(labels)], "layout string, pos int, label string")
    got = {r.i: r.section for r in G.snap_labels(rows, known).collect()}
    for i, a in enumerate(asked):
        text = a.strip()
        exact = [x for x in labels if x.lower() == text.lower()]
        close = get_close_matches(text, labels, n=1, cutoff=0.8) if text and text.lower() != "unknown" else []
        assert got[i] == (exact[-1] if exact else close[0] if close else "unknown")


def test_filters(spark):
    doc = DocumentValues({"bills": ["1", "2", "1"], "none": [], "lr": "X", "blank": ""}, {"day": "2026-01-01"})
    assert resolve({"a": "{blank}", "b": "{lr}"}, doc) == [("b", "=", "X")]
    assert resolve([["n", "in", "{bills}"]], doc) == [("n", "in", ["1", "2"])]
    assert resolve([["n", "in", "{none}"], ["n", "like", "%{none}%"], ["n", "like", "%{blank}%"], "junk"], doc) == []
    assert resolve([["n", "like", "%{bills}%"]], doc) == [("n", "like", "%1%"), ("n", "like", "%2%")]
    assert resolve([["d", ">=", "{context.day}"]], doc) == [("d", ">=", "2026-01-01")]
    table = spark.createDataFrame([("1", 5), ("2", 7), ("3", 9)], "name string, n int")
    assert table_scan(table, None, [["name", "in", "{none}"]], doc=doc, guard=True).count() == 0
    assert table_scan(table, {"n": [">", 5]}, [["name", "in", "{bills}"]], doc=doc, guard=True).count() == 1
    assert table_scan(table, None, guard=True).count() == 0
    assert table_scan(table, None, guard=True, allow_unfiltered=True).count() == 3


def test_contains_join_equals_like(spark):
    import itertools

    hay = ["".join(p) for p in itertools.product("ab1", repeat=4)]
    needles = ["a", "ab", "b1a", "a_b", "1%1", "abab", "zz", "%", "_"]
    refs = spark.createDataFrame([("d", n) for n in needles], "doc string, value string")
    target = spark.createDataFrame([(h, h) for h in hay], "name string, text string")
    got = {(r.value, r.name) for r in C.contains_join(refs, target, "text").collect()}
    like = refs.where("value NOT IN ('%', '_')").crossJoin(target).where("text LIKE concat('%', value, '%')")
    assert got == {(r.value, r.name) for r in like.collect()}


def test_patch_creates_and_protects(spark):
    schema = [Q.FieldSpec("a"), Q.FieldSpec("b"), Q.FieldSpec("l", kind="array")]
    types = f"value string, raw_text string, confidence double, bbox {BOX_TYPE}"
    box, big, new = (0.1, 0.1, 0.1, 0.1), (0.0, 0.0, 0.9, 0.9), (0.5, 0.5, 0.1, 0.1)
    items = spark.createDataFrame(
        [("d", "a", None, "1", "1", 0.5, box), ("d", "l", 0, "x", "x", 0.5, box), ("d", "l", 1, "y", "y", 0.5, box)],
        f"doc string, key string, idx int, {types}",
    )
    repairs = spark.createDataFrame(
        [("d", 1, "a", None, None, None, 0.9, new), ("d", 2, "b", None, "made", None, None, None), ("d", 3, "l", "1", "Y", "yy", None, big),
         ("d", 4, "l", "0", "no", None, None, None), ("d", 5, "zz", None, "no", None, None, None)],
        f"doc string, pos int, key string, idx string, {types}",
    )
    asked = spark.createDataFrame([("d", "a", None), ("d", "b", None), ("d", "l", 1)], "doc string, key string, idx int")
    merged, dropped = Q.patch_merge(items, repairs, asked, schema)
    got = {(r.key, r.idx): (r.value, r.raw_text, tuple(r.bbox) if r.bbox else None, r.repaired) for r in merged.collect()}
    assert got == {
        ("a", None): ("1", "1", new, True),
        ("b", None): ("made", "made", None, True),
        ("l", 0): ("x", "x", box, False),
        ("l", 1): ("Y", "yy", box, True),
    }
    assert [(r.key, r.idx) for r in dropped.collect()] == [("l", 0)]
    rejected = spark.createDataFrame([("d", "a", None, new)], f"doc string, key string, idx int, bbox {BOX_TYPE}")
    again, _ = Q.patch_merge(items, repairs, asked, schema, rejected)
    assert tuple(again.where("key = 'a'").first().bbox) == box


def test_cross_check_does_not_multiply(spark):
    items = spark.createDataFrame([("d", "e", 0, "1"), ("d", "e", 1, "2"), ("d", "f", None, "1")], "doc string, key string, idx int, value string")
    target = spark.createDataFrame([("1",), ("1",)], "n string")
    got = sorted((r.idx, r.cross_check) for r in Q.cross_check(items, target, "e", "n", "Doc").collect())
    assert got == [(0, "matched"), (1, "miss")]


def test_scan_replace_twice_is_once(spark):
    details = spark.createDataFrame([("p1", "s", 0), ("p2", "s", 0), ("p3", "x", 1)], "name string, scanner_document string, is_deleted int")
    saved = spark.createDataFrame([("s",)], "scan string")
    listed = spark.createDataFrame([("p3", "s")], "name string, scan string")
    once = G.replace_scan(details, saved, listed)
    assert sorted(map(tuple, once.collect())) == [("p1", "s", 1), ("p2", "s", 1), ("p3", "s", 0)]
    assert sorted(map(str, G.replace_scan(once, saved, listed).collect())) == sorted(map(str, once.collect()))


def test_access_truth_table(spark):
    cases = [
        ([], "read", "Sales Invoice", "neutral", "allow"), (["AI Bot"], "read", "Sales Invoice", "allow", "allow"),
        (["AI Bot"], "print", "Sales Invoice", "allow", "allow"), (["AI Bot"], "write", "User", "deny", "deny"),
        (["AI Bot"], "delete", "Custom DocPerm", "deny", "deny"), (["AI Bot"], "write", "Sales Invoice", "neutral", "allow"),
        (["AI Bot", "System Manager"], "write", "User", "neutral", "allow"), ([], "write", "User", "neutral", "allow"),
    ]
    df = spark.createDataFrame(cases, "roles array<string>, ptype string, dt string, older string, newer string")
    old = PM.access_decision(F.col("roles"), F.col("dt"), F.col("ptype"))
    new = PM.access_decision(F.col("roles"), F.col("dt"), F.col("ptype"), newer=True)
    assert df.where((old != F.col("older")) | (new != F.col("newer"))).count() == 0


def test_ranking_agrees_with_blocks(spark):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    items = spark.createDataFrame(rows, "item int, vector array<float>")
    queries = items.where("item < 5").withColumnRenamed("item", "query")
    a = sorted(map(tuple, S.rank_items(queries, items).collect()))
    b = sorted(map(tuple, S.rank_items_blocked(queries, items, query_rows=2, item_rows=90).collect()))
    assert a == b and len(a) == 40


def test_capped_fetch_equals_brute_force_on_a_hot_key(spark):
    # two thirds of the records end in the same number
    names = [f"P{i:03d}-{7 if i % 3 else i}" for i in range(90)]
    target = spark.createDataFrame([(n, f"{i % 4}") for i, n in enumerate(names)], "name string, region string")
    refs = [(d, "tail", v, p) for d in range(6) for p, v in enumerate(["7", f"x{d * 3}"])] + [(9, "tail", "none", 0)]
    queries = [{"keys": [{"field": "name", "from": "tail", "match": "suffix"}], "order": "region"}]
    got = C.fetch_candidates(
        spark.createDataFrame(refs, "doc int, kind string, value string, pos int"), target, queries, query_cap=5, document_cap=4
    )
    expected = []
    for d in range(6):
        hit = [(str(i % 4), n) for i, n in enumerate(names) if int(n.split("-")[1]) in (7, d * 3)]
        expected += [(d, n) for _, n in sorted(hit)[:5][:4]]
    assert sorted(map(tuple, got.select("doc", "name").collect())) == sorted(expected)


def test_plugins(spark):
    @PL.register
    class Returns(PL.ExtractionPlugin):
        target_doctype = "Return Goods"

        def validate(self, rows):
            return rows.where("fieldname = 'bad'").select("doc", F.lit("bad field").alias("issue"))

    assert isinstance(PL.get_plugin("Return Goods"), Returns) and PL.has_plugin("Return Goods")
    assert type(PL.get_plugin("Sales Invoice")) is PL.ExtractionPlugin and not PL.has_plugin("Sales Invoice")
    rows = spark.createDataFrame(
        [("d1", "n", "Data", "5", "Pending"), ("d2", "bad", "Data", "x", "Pending"), ("d2", "n", "Data", "6", "Pending")],
        "doc string, fieldname string, fieldtype string, value string, status string",
    )
    lines = spark.createDataFrame([], "doc string, table string, row_no int, raw_json string, resolution_status string, matched_item string, description string")
    columns = spark.createDataFrame([], "table string, column string, fieldtype string")
    links = spark.createDataFrame([], "table string, link_field string")
    target, _, issues = PL.build_documents(rows, lines, PL.get_plugin("Return Goods"), ["n"], columns, links)
    assert [tuple(r) for r in target.collect()] == [("d1", "5")] and issues.count() == 1


def test_output_schema():
    import pytest

    assert output_schema('[{"key": "a", "kind": "array", "required": true}]')[0].required
    for bad in ('{"key": "a"}', '[{"label": "x"}]', "[1]"):
        with pytest.raises(ValueError):
            output_schema(bad)


def test_collision_of_right_aligned_boxes(spark):
    from papertally.operators.quality import colliding_pairs
    from papertally.operators.quality import FieldSpec

    schema = [FieldSpec("p"), FieldSpec("q")]
    a = {"x": 0.12707, "y": 0.5, "w": 0.2499, "h": 0.1}
    b = {"x": 0.083, "y": 0.5, "w": 0.29397, "h": 0.1}
    kind = "doc string, key string, idx int, bbox struct<x:double,y:double,w:double,h:double>"
    for first, second in ((a, b), (b, a)):
        items = spark.createDataFrame([("d", "p", None, first), ("d", "q", None, second)], kind)
        assert colliding_pairs(items, schema).count() == 1


def test_status_edit_keeps_the_value_edit_before(spark):
    import datetime

    from papertally.operators.extraction import apply_field_edits

    rows = spark.createDataFrame([("d", "f", "old", "New")], "doc string, fieldname string, value string, status string")
    at = [datetime.datetime(2024, 1, k) for k in (1, 2)]
    edits = spark.createDataFrame(
        [("d", "f", at[0], "new", None, "u"), ("d", "f", at[1], None, "Approved", "v")],
        "doc string, fieldname string, at timestamp, value string, status string, user string",
    )
    r = apply_field_edits(rows, edits).first()
    assert (r["value"], r["status"], r["edited_by"], r["edited_on"]) == ("new", "Approved", "u", at[0])


def test_index_on_a_single_valued_key(spark):
    import datetime

    from papertally.operators.review import model_values, overlay_corrections
    from papertally.operators.quality import FieldSpec

    schema = [FieldSpec("s"), FieldSpec("t")]
    items = spark.createDataFrame([("d", "s", None, "old", "old")], "doc string, key string, idx int, value string, raw_text string")
    at = datetime.datetime(2024, 1, 1)
    folded = spark.createDataFrame(
        [("d", "s", 0, "corrected", "new", "u", at), ("d", "t", 0, "corrected", "no", "u", at)],
        "doc string, field string, idx int, verdict string, value string, by string, at timestamp",
    )
    added = spark.createDataFrame([], "doc string, field string, value string, by string, at timestamp, pos int")
    got = [(r["key"], r["value"]) for r in overlay_corrections(items, folded, added, schema).collect()]
    assert got == [("s", "new")]
    assert {r["field"]: r["model_value"] for r in model_values(folded, items).collect()} == {"s": "old", "t": None}


def test_clear_in_a_later_batch(spark):
    import datetime

    from papertally.operators.review import feedback_fold, last_feedback

    kind = "doc string, field string, idx int, verdict string, value string, by string, at timestamp, seq bigint"
    batch = lambda verdict, day: spark.createDataFrame(
        [("d", "f", None, verdict, None, "u", datetime.datetime(2024, 1, day), day)], kind
    )
    results = last_feedback(batch("wrong", 1)).unionByName(last_feedback(batch("clear", 2)))
    assert feedback_fold(results).count() == 0


def test_backslash_in_a_searched_value(spark):
    from papertally.operators.candidates import contains_join

    target = spark.createDataFrame([("k1", r"xA\1y"), ("k2", "other")], "name string, text string")
    refs = spark.createDataFrame([("d", r"A\1"), ("d", r"A\2")], "doc string, value string")
    got = contains_join(refs, target, "text", "name").select("value", "name").collect()
    assert [tuple(r) for r in got] == [(r"A\1", "k1")]


def test_words_of_long_lines_keep_their_places(spark):
    from types import SimpleNamespace

    from papertally.catalog import texts

    words = [f"w{i}" for i in range(1200)]
    words[700] = "zyxwvutsrqponm"
    docs = spark.createDataFrame([(1, "first line\n" + " ".join(words))], "doc_id bigint, text string")
    placed = texts.document_words(SimpleNamespace(documents=docs)).where("line = 1").collect()
    assert {r["text"]: r["bbox"]["x"] for r in placed} == {w: i / 1200 for i, w in enumerate(words)}
    ends = sorted((r["bbox"]["x"], r["bbox"]["x"] + r["bbox"]["w"]) for r in placed)
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    targets = texts.document_targets(SimpleNamespace(documents=docs)).where("target = 'read'")
    best = LO.top_clusters(LO.scored_windows(texts.document_words(SimpleNamespace(documents=docs)), targets)).where("rank = 1").first()
    assert best["text"] == words[700] and (best["bbox"]["x"], best["bbox"]["y"]) == (round(700 / 1200, 4), 0.5)


def test_every_candidate_of_an_order_gives_reasons(spark, monkeypatch):
    from papertally.catalog import matching
    from papertally.plans import reconcile

    asked = {}

    def resolve(*args, **kwargs):
        asked.update(kwargs)
        raise InterruptedError

    monkeypatch.setattr(matching, "references", lambda t: None)
    monkeypatch.setattr(matching, "parties", lambda t: None)
    monkeypatch.setattr(reconcile, "resolve_documents", resolve)
    with pytest.raises(InterruptedError):
        matching.reference_reasons(None)
    assert not any(asked.values())


@pytest.mark.parametrize("name", ["memory_lookup_whole", "dashboard_access_whole"])
def test_every_row_and_supplier_takes_part(spark, name):
    from __spark_entry__ import queries

    folder = "/root/testdata/sf0.001"
    asked, supplier = ("part", "supplier") if name.startswith("memory") else ("orders", "name")
    got = queries()[name](spark, folder).select(supplier).collect()
    assert len(got) == spark.read.parquet(f"{folder}/{asked}.parquet").count()
    assert len(set(got)) == spark.read.parquet(f"{folder}/supplier.parquet").count()
