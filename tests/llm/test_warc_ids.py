"""Rows without an id in archives."""

from __future__ import annotations

from gridclime.llm import warc


def test_null_ids_come_back_as_null(spark):
    pages = spark.createDataFrame([(None, "u", "x"), (None, "v", "x"), (1, "u", "x"), (2, "u", "x"), (None, "u", None)], "page_id long, url string, html string")
    got = sorted((r.id or 0, r.type, r.refers_to or 0, r.url, r.length) for r in warc.round_trip(pages).collect())
    assert got == [
        (0, "response", 0, "u", 0), (0, "response", 0, "u", 1), (0, "response", 0, "v", 1), (1, "revisit", 2, "u", 1), (2, "response", 0, "u", 1),
    ]
