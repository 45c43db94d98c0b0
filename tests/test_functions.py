"""Scalar cases: one small DataFrame per function."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from papertally.functions import boxes as B
from papertally.functions import dates as D
from papertally.functions import formats as FM
from papertally.functions import numbers as N
from papertally.functions import replies as RP
from papertally.functions import text as T
from papertally.functions.ratio import letter_bound, letter_set_bound, matching_blocks_ratio
from papertally.functions.vectors import cosine


def column(spark, values, expression, dtype="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_boxes(spark):
    texts = [
        "[100,100,140,300]", "[100,100,100,300]", '"nope"', "[0.9,0.9,1.4,1.4]",
        '{"x": 0.1, "y": 0.1, "w": 0.2, "h": 0.04}', '["NaN",1,2,3]', '{"x": 100, "y": 100, "w": 200, "h": 40}', "[1,2,3]",
    ]
    got = column(spark, texts, B.box_from_json)
    assert tuple(got[0]) == (0.1, 0.1, 0.2, 0.04)
    assert got[1] is None and got[2] is None and got[5] is None and got[7] is None
    assert tuple(got[3]) == (0.9, 0.9, 0.1, 0.1)
    assert tuple(got[4]) == tuple(got[6]) == (0.1, 0.1, 0.2, 0.04)


def test_lenient_box_keeps_empty_and_scale(spark):
    got = column(spark, ["[100,100,100,300]", '{"x": 2, "y": 0.1, "w": 0.2, "h": 0.1}'], lambda c: B.box_from_json(c, strict=False))
    assert tuple(got[0]) == (0.1, 0.1, 0.2, 0.0)
    assert tuple(got[1]) == (1.0, 0.1, 0.0, 0.1)


def test_formats(spark):
    def run(value, fmt, raw=None):
        df = spark.createDataFrame([(value, raw)], "v string, r string")
        return tuple(df.select(FM.normalize(F.col("v"), F.col("r"), fmt).alias("n")).select("n.*").first())

    assert run("1234 5678 9012", "digits:12") == ("123456789012", True)
    assert run("12345", "digits:12") == ("12345", False)
    assert run("₹1,554.00", "amount") == ("1554.0", True)
    assert run("Rs. 554", "amount") == ("0.55", True)
    assert run("9" * 320, "amount") == ("9" * 320, False)
    assert run("n/a", "amount") == ("n/a", False)
    assert run("GR 12 345", "strip-spaces") == ("GR12345", True)
    assert run("IND57794", "strip-spaces", "IND-57794") == ("IND-57794", True)
    assert run("IND57794", "strip-spaces", "No IND-57794") == ("IND57794", True)
    assert run("AB12", r"regex:[A-Z]{2}\d{2}") == ("AB12", True)
    assert run("AB123", r"regex:[A-Z]{2}\d{2}") == ("AB123", False)
    assert run("", "digits:12") == ("", True)
    assert run("32/13/2026", "date:indian-ddmmyyyy") == ("32/13/2026", False)


def test_dates(spark):
    texts = ["12/05/2026", "12 May 2026", "2026-05-12", "12-5-26", "12.05.202", "31/02/2026", "12 Foo 2026", None, "29/2/2024"]
    assert column(spark, texts, D.indian_date) == [
        "2026-05-12", "2026-05-12", "2026-05-12", "2026-05-12", "0202-05-12", None, None, None, "2024-02-29",
    ]


def test_relative_day(spark):
    got = column(spark, ["-60d", "+3d", "3", "always"], lambda c: D.relative_day(F.lit("2026-03-01").cast("date"), c))
    assert got == ["2025-12-31", "2026-03-04", "2026-03-04", "always"]


def test_suffix_and_keys(spark):
    assert column(spark, ["INV2627-01422", "1422", "INV2627-11422", "ABC", "000", None], T.trailing_digits) == [
        "1422", "1422", "11422", None, "0", None,
    ]
    assert column(spark, ["TND - 2493"], T.match_key) == ["tnd2493"]
    assert column(spark, ["  Blue \n BOLT "], T.text_key) == ["blue bolt"]
    assert column(spark, ["  Hello, World! " * 20], T.slug)[0][:12] == "hello-world-"
    assert column(spark, ['["a", " a ", "b"]', "a, b\na", "[broken", None], T.user_list) == [["a", "b"], ["a", "b"], ["[broken"], []]
    assert column(spark, ["{a {b}", "{a}", None], T.looks_truncated) == [True, False, False]
    assert column(spark, ["web.error.log.2", "a.txt"], T.log_namespace) == ["web.error", None]


def test_numbers(spark):
    texts = ["1,234.9", "", None, "12abc", "1d", "-3.7", "0x10", "1e3"]
    assert column(spark, texts, N.cint) == [1234, 0, 0, 0, 0, -3, 0, 1000]
    assert column(spark, texts, N.flt) == [1234.9, 0.0, 0.0, 0.0, 0.0, -3.7, 0.0, 1000.0]
    assert math.isnan(column(spark, ["nan"], N.flt)[0])


def test_coercion_keeps_what_does_not_fit(spark):
    rows = [("Check", "YES", "1"), ("Check", "x", "0"), ("Int", "1,200.9", "1200"), ("Int", "a lot", "a lot"), ("Float", "junk", "0.0"),
            ("Date", "2026-05-12", "2026-05-12"), ("Date", "soon", "soon"), ("Data", "  a ", "a"), ("Data", " ", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, v string, e string")
    for r in df.select("e", N.coerce_value(F.col("t"), F.col("v")).alias("got")).collect():
        assert r.got == r.e


def test_call_cost(spark):
    df = spark.createDataFrame(
        [("0.5", "1", "1", "Success"), (None, "1000", "500", "Success"), (None, None, None, "Failed"), (None, None, None, "Success")],
        "c string, p string, o string, s string",
    )
    cost = N.call_cost(F.col("c"), F.col("p"), F.col("o"), F.lit("1.0"), F.lit("2.0"), F.col("s"))
    got = [tuple(r) for r in df.select(cost.alias("x")).select("x.*").collect()]
    assert got == [(0.5, 0), (0.002, 1), (0.0, 1), (0.0, 0)]


def test_replies(spark):
    texts = [
        '{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": 1,} bye', "x [1, 2,] y", "nothing", "null", None,
        'first {"a": 1} then [2]', "",
    ]
    got = column(spark, texts, lambda c: F.to_json(RP.parse_reply(c)))
    assert got == ['{"a":1}', '{"a":1}', '{"a":1}', "[1,2]", None, None, None, '{"a":1}', None]


def test_redaction(spark):
    body = '{"m": [{"type": "image_url", "image_url": {"url": "data:abc"}}, {"text": "data:abc"}]}'
    assert column(spark, [body, "{}"], RP.redact_images) == [
        '{"m": [{"type": "image_url", "image_url": {"url": "<image redacted: 8 chars>"}}, {"text": "data:abc"}]}', "{}",
    ]


def test_render(spark):
    df = spark.createDataFrame([("Ann", None)], "name string, age int")
    text = T.render_template("Hi {{ name }}, {{age}}{{ other }}!", {"name": F.col("name"), "age": F.col("age")})
    assert df.select(text).first()[0] == "Hi Ann, !"
    assert T.render_template("", {}) is not None


def test_labels_and_variants(spark):
    df = spark.createDataFrame([("creation", " ", None), ("posting_date", None, None), ("x", " Own ", "m"), ("x", "", "Meta")], "f string, c string, m string")
    assert [r[0] for r in df.select(T.field_label(F.col("f"), F.col("c"), F.col("m"))).collect()] == ["Created On", "Posting Date", "Own", "Meta"]
    df = spark.createDataFrame([("554", "554.0"), ("", "a"), (None, None)], "r string, v string")
    assert [r[0] for r in df.select(T.value_variants(F.col("r"), F.col("v"))).collect()] == [["554", "554.0"], ["a"], []]


def test_ratio_and_its_bounds(spark):
    from difflib import SequenceMatcher

    pairs = [("tnd2493", "tnd24s3"), ("abcd", "axbxcxd"), ("aabb", "bbaa"), ("assistant", "assistants"), ("x", "y")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", matching_blocks_ratio(a, b).alias("r"), letter_bound(a, b).alias("l"), letter_set_bound(a, b).alias("s")).collect()
    for r in rows:
        assert abs(r.r - SequenceMatcher(None, r.a, r.b).ratio()) < 1e-12
        assert r.l >= r.r - 1e-12 and r.s >= r.l - 1e-12


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0]), ([0.0], [1.0]), ([], [1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(F.round(cosine(F.col("a"), F.col("b")), 6)).collect()] == [1.0, 0.0, 0.0, 1.0]


def test_amounts_beyond_decimals(spark):
    rows = [("1e9",), ("9" * 40,), ("1" + "0" * 36,), ("9" * 310,), ("12.345",)]
    df = spark.createDataFrame(rows, "v string").select(FM.normalize(F.col("v"), F.lit(None).cast("string"), "amount").alias("r"))
    assert [(r.r.value, r.r.ok) for r in df.collect()][1:] == [("1.0E40", True), ("1.0E36", True), ("9" * 310, False), ("12.35", True)]
