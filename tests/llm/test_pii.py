"""Entities that a quick test or a rejected candidate could hide."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from gridclime.llm import pii, queries

SF_DIR = "/root/testdata/sf0.01"
CARD = "4111 1111 1111 1111"


def found(text):
    return [(k, text[a:b]) for a, b, k, _ in pii.entities(text)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("in 2024 743-555-3824", [("phone", "743-555-3824")]),
        ("Room 100 743-555-3824 and", [("phone", "743-555-3824")]),
        ("2024 123-45-6789", [("ssn", "123-45-6789")]),
        (f"Nr 100 {CARD}", [("card", CARD)]),
        (f"{CARD} 124", [("card", CARD)]),
        ("12 34 56 78 90 12 34 743-555-3824", [("phone", "743-555-3824")]),
        ("1234 5678 9012 3456", []),
    ],
)
def test_rejected_card_hides_nothing(text, expected):
    assert found(text) == expected


SECRETS = [
    "key = 'abcdefghijklmnopqrstuvwx'", 'key: "ABCDEFGHIJKLMNOPQRSTUVWX"', "use ghp_" + "abcdefghijkl" * 3, "sk-" + "abcdefghij" * 2,
    "AKIA" + "ABCDEFGH" * 2, "abcdefabcd" * 4, "+٤٩ ١٥١ ٢٣٤ ٥٦٧٨",
]


def test_quick_test_passes_every_entity(spark):
    texts = SECRETS + [f"Herr {n} kam" for n in ("Öz", "Иванов")] + ["Mary Smith kam", "Jean-Pierre Dupont", "no entity here"]
    if os.path.isdir(SF_DIR):
        texts += [r.text for r in queries.table(spark, SF_DIR, "documents").collect() if r.text]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    passed = {r.i for r in df.where(F.col("text").rlike(pii.QUICK)).collect()}
    assert {i for i, t in enumerate(texts) if any(True for _ in pii.entities(t))} <= passed


def test_secrets_without_digits_are_replaced(spark):
    out = pii.replace_pii(spark.createDataFrame([(t,) for t in SECRETS], "text string"), "k").collect()
    assert all(len(r.pii_types) == 1 for r in out)
    assert not {r.text for r in out} & set(SECRETS) and not any(re.search("[٠-٩]", r.text) for r in out)


@pytest.mark.parametrize(
    "text, gone",
    [
        ("Dr Anna Keller came. Keller said that Anna left; Keller's bag.", ["Anna", "Keller"]),
        ("Keller wrote. Later Frau Keller came.", ["Keller"]),
        ("Then Mary Smith came, and Smith left.", ["Mary", "Smith"]),
        ("Prof. Dr. Anna J. Keller and MARY KELLER.", ["Anna", "Keller", "KELLER"]),
        ("Jean-Pierre Dupont met Анна Иванова.", ["Jean-Pierre", "Dupont", "Анна", "Иванова"]),
    ],
)
def test_later_and_untitled_names_are_replaced(spark, text, gone):
    new = pii.replace_pii(spark.createDataFrame([(text,)], "text string"), "k").first().text
    assert not [g for g in gone if g in new]


def test_mentions_stay_one_person(spark):
    text = "Dr Anna Keller came. Keller said that Anna left. Mary Smith: ask Keller's friend."
    new = pii.replace_pii(spark.createDataFrame([(text,)], "text string"), "k").first().text
    m = re.fullmatch(r"Dr (\S+) (\S+) came\. (\S+) said that (\S+) left\. \S+ \S+: ask (\S+)'s friend\.", new)
    assert m[1] == m[4] and m[2] == m[3] == m[5] and m[1] != m[2]


def test_words_that_are_no_names_stay():
    assert not list(pii.entities("The keller of Anna is in May. Mark my words, Rosa."))
    assert [s for _, s in found("Mr Stone saw a stone and Stonehenge.")] == ["Stone"]


def test_private_addresses_do_not_run_out(spark, tmp_path):
    n = 40_000
    df = spark.range(n).select(F.lit("ip").alias("type"), F.expr("concat('192.168.', id div 256, '.', id % 256)").alias("value")).coalesce(4)
    df.write.parquet(f"{tmp_path}/found")
    found = spark.read.parquet(f"{tmp_path}/found")
    own = {r.value: r.surrogate for r in pii.override_table(found, b"k", pii.Tables(spark, "pii")).collect()}
    new = {v: own.get(v) or pii.surrogate(b"k", "ip", v) for v in (r.value for r in found.collect())}
    assert len(new) == len(set(new.values())) == n and not set(new) & set(new.values())
