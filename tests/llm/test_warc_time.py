"""Capture times of archived pages."""

from __future__ import annotations

import datetime as dt

from tapeloom.llm import warc


def test_given_times_order_a_history(spark):
    at = dt.datetime(2023, 5, 1, 12)
    rows = [(1, "http://a.b/", "x", at + dt.timedelta(days=2)), (2, "http://a.b/", "y", at + dt.timedelta(microseconds=1)), (3, "http://a.b/", "z", at), (4, "http://a.b/", "w", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, seen timestamp_ntz")
    got = [(r["page_id"], r["captured_at"]) for r in warc.archive(pages, captured_at="seen").collect()]
    assert got == [(3, "2023-05-01T12:00:00.000000Z"), (2, "2023-05-01T12:00:00.000001Z"), (1, "2023-05-03T12:00:00.000000Z"), (4, "2024-01-01T00:00:04.000000Z")]


def test_made_up_times_do_not_wrap_after_a_year(spark):
    pages = spark.createDataFrame([(5, "http://a.b/", "x"), (31_536_001, "http://a.b/", "y"), (2**62, "http://a.b/", "z")], "page_id long, url string, html string")
    got = [(r["page_id"], r["captured_at"]) for r in warc.archive(pages).collect()]
    assert got[:2] == [(5, "2024-01-01T00:00:05Z"), (31_536_001, "2024-12-31T00:00:01Z")] and len(got) == 3
