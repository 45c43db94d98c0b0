"""Files and streams in a temporary folder."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from papertally.sources import logs, ocr, sheets
from papertally.streaming import jobs


def test_sheet(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('a,b,a\n1,2,3,4\n5\n"x,y",,z\n')
    rows = sheets.read_sheet(spark, str(path))
    assert rows.columns == ["a", "b"]
    assert sorted(map(tuple, rows.collect()), key=str) == [("3", "2"), ("z", None), (None, None)]
    out = str(tmp_path / "out")
    sheets.write_sheet(spark.createDataFrame([(1, None), (None, "t")], "n int, s string"), out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["n", "s"] and back.count() == 2


def test_ocr_words(spark, tmp_path):
    path = tmp_path / "p.tsv"
    head = "\t".join(ocr.COLUMNS)
    rows = [
        "5\t1\t1\t1\t1\t1\t100\t50\t200\t20\t91.5\tTND-2493", "5\t1\t1\t1\t1\t2\t100\t50\t200\t20\t12\tunsure",
        "4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t", "5\t1\t1\t1\t1\t3\tx\t50\t200\t20\t95\tbroken", "5\t1\t1\t1\t1\t4\t0\t0\t0\t20\t95\tflat",
        "5\t1\t1\t1\t1\t5\t0\t0\t5\t5\tn/a\tnoconf", '5\t1\t1\t2\t1\t6\t0\t0\t5\t5\t95\t"quoted', "5\t1\t1\t2\t1\t7\t0\t0\t5\t5\t95\t  ",
    ]
    path.write_text("\n".join([head, *rows]) + "\n")
    words = ocr.word_boxes(ocr.read_tsv(spark, str(path)), F.lit(1000), F.lit(500), F.col("file"))
    got = {r.text: (tuple(r.line), tuple(r.bbox)) for r in words.collect()}
    assert set(got) == {"TND-2493", '"quoted'}
    assert got["TND-2493"] == (("1", "1", "1"), (0.1, 0.1, 0.2, 0.04))


def test_logs(spark, tmp_path):
    for name in ("web.log", "web.log.1", "web.error.log.2", "note.txt"):
        (tmp_path / name).write_text("x")
    found = logs.log_inventory(logs.file_names(spark, str(tmp_path)))
    assert {r.namespace: r.files for r in found.collect()} == {"web": 2, "web.error": 1}


def test_call_log_is_append_only(spark, tmp_path):
    out = str(tmp_path / "calls")
    row = ("{}", "r" * 200000, "e" * 900, None, "5", None, "7", None, datetime.datetime(2026, 1, 2))
    calls = spark.createDataFrame(
        [row],
        "request_payload string, response_payload string, error_message string, cost_usd string, prompt_tokens string, "
        "completion_tokens string, total_tokens string, cost_estimated string, creation timestamp",
    )
    logs.append_calls(calls, out)
    logs.append_calls(calls, out)
    back = spark.read.parquet(out)
    first = back.first()
    assert back.count() == 2 and len(first.response_payload) == 200000 and len(first.error_message) == 900
    assert (first.prompt_tokens, first.completion_tokens, first.cost_usd, str(first.day)) == (5, 0, 0.0, "2026-01-02")


def test_streams(spark, tmp_path):
    queue, out, mark = (str(tmp_path / n) for n in ("queue", "out", "mark"))
    log = spark.createDataFrame(
        [("l1", "q1", "Processing", "Email"), ("l2", "q2", "Processing", "Email"), ("l3", None, "Processing", "Email")],
        "name string, email_queue string, log_status string, share_type string",
    )
    spark.createDataFrame([("q1", "Sent"), ("q2", "Sending")], "name string, status string").write.parquet(queue)
    jobs.stream_delivery(spark, queue, log, out, mark).awaitTermination()
    assert [(r.name, r.log_status) for r in spark.read.parquet(out).collect()] == [("l1", "Success")]

    calls = str(tmp_path / "calls")
    spark.createDataFrame([("r", 5, 0.5, 0), ("r", 7, 0.25, 1)], "run string, total_tokens bigint, cost_usd double, cost_estimated int").write.parquet(calls)
    jobs.stream_run_totals(spark, calls, out + "2", mark + "2").awaitTermination()
    got = spark.read.parquet(out + "2").first()
    assert (got.total_tokens, got.cost_usd, got.cost_estimated) == (12, 0.75, 1)

    events = str(tmp_path / "events")
    at = datetime.datetime(2026, 1, 1)
    spark.createDataFrame(
        [("d", "f", None, "wrong", None, "u", at, 1), ("d", "f", None, "correct", None, "u", at, 2)],
        "doc string, field string, idx int, verdict string, value string, by string, at timestamp, seq bigint",
    ).write.parquet(events)
    jobs.stream_feedback(spark, events, out + "3", mark + "3").awaitTermination()
    assert spark.read.parquet(out + "3").first().verdict == "correct"
