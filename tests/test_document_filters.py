"""Conditions by document against the same conditions applied one document at a time."""

from __future__ import annotations

import random
import re

from papertally.operators import candidates as C
from papertally.operators import document_filters as DF
from papertally.operators import filters as FL


def like(text, pattern):
    parts = (".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return re.fullmatch("".join(parts), text, re.S) is not None


def number(text):
    try:
        return float(text)
    except ValueError:
        return None


def holds(record, condition):
    field, op, value = condition
    text = record[field]
    if text is None:
        return False
    if op in ("in", "not in"):
        return (text in value) == (op == "in")
    if op in ("like", "not like"):
        return like(text, value) == (op == "like")
    a, b = number(text), number(value)
    left, right = (text, value) if a is None or b is None else (a, b)
    return {"=": text == value, "!=": left != right, ">": left > right, "<=": left <= right}[op]


def plainly(docs, records, filters, or_filters):
    """(doc, key) pairs, and the documents the guard holds back."""
    rows, guarded = [], set()
    for doc, fields in docs.items():
        held = FL.DocumentValues(fields, {"city": "Bonn"} if doc % 3 else {})
        every, some = FL.resolve(filters, held), FL.resolve(or_filters, held)
        own = [c for c in every if c[0] != "fixed"]
        keyed = [c for c in own if c[1] in ("=", "in", "like")]
        by_some = some and all(c[0] != "fixed" and c[1] in ("=", "in", "like") for c in some)
        if (or_filters and not some) or not (keyed or by_some):
            guarded.add(doc)
            continue
        for record in records:
            if all(holds(record, c) for c in every) and (not or_filters or any(holds(record, c) for c in some)):
                rows.append((doc, record["id"]))
    return sorted(rows), guarded


def check(spark, filters, or_filters):
    pick = random.Random(3)
    names = [None, "", "ab%c", "a\\b", "x_y", "Main Road 12", "main road", "Bonn", "7", "07", "q" * 9000 + "needle" + "r" * 1000, "needle", "100%"]
    records = [
        {"id": i, "name": pick.choice(names), "code": str(pick.randint(0, 9)), "city": pick.choice(["Bonn", "Rome", None]), "fixed": pick.choice("ab")}
        for i in range(80)
    ]
    docs, fields = {}, []
    for doc in range(60):
        own = {}
        if pick.random() < 0.6:
            own["code"] = pick.choice(["1", "2", "", None, "07"])
        if pick.random() < 0.6:
            own["names"] = pick.sample([n for n in names if n is None or len(n) < 100], pick.randint(0, 3))
        if pick.random() < 0.5:
            own["bound"] = pick.choice(["3", "5", "x"])
        docs[doc] = own
        for key, entry in own.items():
            listed = isinstance(entry, list)
            fields += [(doc, key, i, v, listed) for i, v in enumerate(entry if listed else [entry])]
            if listed and not entry:
                fields.append((doc, key, 0, None, True))
    values = DF.Values(
        spark.createDataFrame(fields, "doc int, key string, idx int, value string, listed boolean"),
        spark.createDataFrame([(d, "city", "Bonn") for d in docs if d % 3], "doc int, key string, value string"),
    )
    table = spark.createDataFrame([tuple(r.values()) for r in records], "id int, name string, code string, city string, fixed string")
    out = DF.fetch_by_document(spark.createDataFrame([(d,) for d in docs], "doc int"), values, table, "id", filters, or_filters)
    rows, guarded = plainly(docs, records, filters, or_filters)
    got = sorted(map(tuple, out.rows.collect()))
    assert got == rows, [(docs[d], records[k]) for d, k in set(got) ^ set(rows)]
    assert {r.doc for r in out.documents.collect() if r.guarded} == guarded
    assert out.documents.count() == len(docs)
    return rows, guarded


def test_alternatives_with_checks(spark):
    filters = [["fixed", "=", "a"], ["city", "=", "{context.city}"], ["code", ">", "{bound}"]]
    rows, guarded = check(spark, filters, [["code", "in", "{code}"], ["name", "like", "%{names}%"]])
    assert rows and guarded


def test_conditions_that_hold_together(spark):
    rows, guarded = check(spark, [["code", "=", "{code}"], ["name", "not in", "{names}"], ["code", "<=", "{bound}"]], None)
    assert rows and guarded
    rows, _ = check(spark, [["name", "like", "%{names}"], ["code", "!=", "{code}"]], [["fixed", "=", "b"], ["code", "in", "{bound}"]])
    assert rows


def test_patterns_in_long_texts(spark):
    texts = {1: "q" * 9990 + "needle" + "r" * 4, 2: "a\\b", 3: "a%b", 4: "axb", 5: "", 6: None, 7: "naïve röd", 8: "ab"}
    table = spark.createDataFrame([(k, v) for k, v in texts.items()], "id int, text string")
    asked = ["%needle%", "needle%", "%a\\b%", "%a%b%", "a_b", "%ï%r_d", "%", "_", "%rrrr", "%zz%", "", "b"]
    hits = C.pattern_hits(spark.createDataFrame([(p,) for p in asked], "pattern string"), table, "text", "id")
    expected = [(p, k) for p in asked for k, t in texts.items() if t is not None and p.strip("%_") and like(t, p)]
    assert sorted(map(tuple, hits.collect())) == sorted(expected)


def test_a_contains_key_among_the_keys_of_a_fetch(spark):
    refs = spark.createDataFrame([(1, "bill", "77", 0), (2, "bill", "9", 0), (2, "street", "Road", 1)], "doc int, kind string, value string, pos int")
    table = spark.createDataFrame([("SI-77-a", "78", "x"), ("b", "8", "Main Road"), ("c", "9", None)], "name string, bill string, address string")
    queries = [{"keys": [{"field": "bill", "from": "bill"}, {"field": "address", "from": "street", "match": "contains"}]},
               {"keys": [{"field": "name", "from": "bill", "match": "contains"}]}]
    rows = C.fetch_candidates(refs, table, queries)
    assert sorted((r.doc, r.name, r.query_ord) for r in rows.collect()) == [(1, "SI-77-a", 1), (2, "b", 0), (2, "c", 0)]
