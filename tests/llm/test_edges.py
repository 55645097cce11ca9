"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridclime.llm import decontaminate, fingerprint, jaccard_join, language, license_scan, mixing, pii, quality, url_filter, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
TEXT = " ".join(WORDS)
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, point long, score double, lang_pred string, "
    "shard long, license string, licenses string, pii_types string, row long, size long, taken long, verdict string, host string"
)


def rows():
    texts = {
        1: TEXT, 2: None, 3: "", 4: "  \n ", 5: "!!! 123", 6: TEXT + " " + " ".join(f"w{i}" for i in range(30_000)), 7: "one",
        8: TEXT + " extra", 9: "Mail a.b@example.org or +1 (743) 555-3824. Released under the MIT License.",
    }
    out = [(i, t, "en" if i % 2 else None, None if i == 7 else f"s{i % 3}", len(t or ""), *[None] * 12) for i, t in texts.items()]
    return out + [out[0], (None, TEXT, None, None, None, *[None] * 12)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(docs, nothing):
    got = fingerprint.edited_likeness(docs).collect()
    assert len(got) == 11 and not fingerprint.edited_likeness(nothing).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].fingerprint == by[3][0].fingerprint and by[2][0].n_chars == 0
    assert by[1][0].fingerprint == by[1][1].fingerprint == by[None][0].fingerprint
    assert by[1][0].near_next == 1.0 and all(0 <= r.near_edited <= 1 for r in got)


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {1, 6, 8, None}
    assert not decontaminate.contaminated(nothing, items).collect() and not decontaminate.contaminated(docs, items.where("false")).collect()


def test_license_scan(docs, nothing):
    got = {r.doc_id: r.license for r in license_scan.scan(docs).collect()}
    assert got[9] == "MIT" and sum(v is not None for v in got.values()) == 1
    assert not license_scan.scan(nothing).collect()


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (7, 1), (5, 0), (4, 0), (2, 1), (99, None)], "doc_id long, quality int")
    w = quality.train(docs, labels)
    got = quality.classify(docs, w).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert not quality.classify(nothing, quality.train(nothing, labels)).collect()


def test_language(docs, nothing):
    model = language.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (2, 3, 4, 5)) and got[6] == ("en", 1.0)
    assert not language.identify(nothing, language.train(nothing)).collect()


def test_url_filter(spark):
    urls = [
        (1, None), (2, ""), (3, "no scheme/de/"), (4, "http://A.example.COM/de/x"), (5, "http://x.net"), (6, "http://x.net/"),
        (7, "http://example.net/en/1"), (8, "http://casino.example.org/"), (9, "http://casinos-x.org/fr/"), (10, "http://bet-free.org/"),
        (11, "http://alphabet.org/freedom"), (11, "http://alphabet.org/freedom"), (12, "http://free-free.org/"),
    ]
    df = spark.createDataFrame([(*u, "x", "y") for u in urls], "page_id long, url string, verdict string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got[1] == got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.com", "/de/x", "example.com/de/", "block") and got[5] == ("x.net", "", None, "allow")
    assert got[6][2:] == ("net/", "block") and got[7][2:] == ("example.net/en/", "allow")
    assert got[8][3] == "block" and got[9][3] == "allow" and got[10][3] == "block" and got[11][3] == "allow" and got[12][3] == "allow"


def test_pii(docs, nothing):
    out = pii.replace_pii(docs, "k")
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 11 and got[2].text is None and got[6].text == rows()[5][1]
    assert got[9].pii_types == ["email", "phone"] and "a.b@" not in got[9].text and "555-3824" not in got[9].text
    assert got[9].text.endswith("Released under the MIT License.")
    assert not pii.replace_pii(nothing, "k").collect()


def test_jaccard(docs, nothing):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
    assert ("1", 16, 1) in got and ("8", 17, 1) in got and ("2", 0, 2) in got and ("7", 1, 7) in got and ("None", 16, 1) in got
    assert len(got) == 11 and not jaccard_join.jaccard_components(nothing).collect()


def test_mixing(docs, nothing):
    got = mixing.mix(docs)[0].collect()
    assert len(got) == 11 and all(r.taken <= 2 * r.size for r in got) and not mixing.mix(nothing)[0].collect()
    for s in {r.source for r in got}:
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 1


def test_warc(spark):
    pages = spark.createDataFrame(
        [(1, "u", "x"), (2, None, "x"), (3, "u\r\nv", None), (4, "u", ""), (5, "u", "y" * 100_000), (5, "u", "y" * 100_000)],
        "page_id long, url string, html string",
    )
    got = sorted((r.id, r.type, r.refers_to, r.length) for r in warc.round_trip(pages, split=50).collect())
    assert got == [
        (1, "revisit", 2, 1), (2, "response", None, 1), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 100_000),
        (5, "response", None, 100_000),
    ]
    assert not warc.round_trip(pages.where("false")).collect()


def test_stages(spark, docs, nothing, tmp_path):
    spark.createDataFrame([(1, TEXT + " more words of an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for label, df in (("some", docs), ("none", nothing)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path))
            assert k == 4 or out.columns == df.columns
            out.write.parquet(f"{tmp_path}/{name}-{label}")
            df = spark.read.parquet(f"{tmp_path}/{name}-{label}")
    assert not spark.read.parquet(f"{tmp_path}/mixture-none").collect()
