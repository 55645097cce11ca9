"""op13: the audit against applying every order to the documents themselves."""

from __future__ import annotations

import re
from itertools import permutations

from pyspark.sql import functions as F

from gridclime.llm import filter_audit

WORDS = " ".join(f"w{i}" for i in range(60))


def brute(docs, labels):
    """Rows of the report, by removing documents filter after filter."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first, fails = {}, []
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append(
            {
                "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i,
            }
        )
    out = []
    for p in {part or "" for _, _, part in docs}:
        own = [(i, f) for (i, _, part), f in zip(docs, fails) if (part or "") == p]
        removed_by = {f: 0 for f in "ABCDE"}
        for order in permutations("ABCDE"):
            left = list(own)
            for f in order:
                removed_by[f] += sum(x[f] for _, x in left)
                left = [d for d in left if not d[1][f]]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone, stay = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                out.append(
                    (
                        p, "".join(order), step, len(stay), len(gone), sum(x[f] for _, x in own) - len(gone),
                        sum([k for k in x if x[k]] == [f] for _, x in own), sum(i in good for i, _ in gone),
                        sum(i in toxic for i, _ in gone), removed_by[f],
                    )
                )
                left = stay
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def report(spark, docs, labels):
    names = "doc_id long, text string, source string, hash int, mask int, n int, id int, part int, key int, quality int, toxic int"
    given = spark.createDataFrame([(*d, 1, 1, 1, 1, 1, 1, 1, 1) for d in docs], names)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(given, marks)
    assert out.columns == COLUMNS and {t for n, t in out.dtypes if n not in ("part", "filter_order", "step")} == {"bigint"}
    return sorted(tuple(r) for r in out.collect())


DOCS = [
    (3, WORDS, "a"), (1, WORDS, "a"), (2, WORDS, "b"), (2, WORDS, "b"), (4, None, "a"), (5, "", None), (6, "", ""),
    (7, "same " * 80, "b"), (8, "LOUD " * 60 + "#", "b"), (9, "LOUD " * 60 + "#", "c"), (10, WORDS + " $", None), (None, WORDS, "a"),
    (None, "LOUD", "a"), (2, "another text of id 2", "b"), (11, "É" * 10, "c"), (12, " \t\n ", "c"), (13, "x " * 20_000, "c"),
    (14, "a b " * 49, "c"), (15, "one", "a"), (16, "One", "a"),
]
LABELS = [(1, 1, 0), (3, 1, 1), (3, 0, None), (4, None, None), (7, 0, 1), (8, 1, 1), (99, 1, 1), (None, 1, 1), (2, 1, 0), (2, 1, 0)]


def test_report_equals_every_order_applied(spark):
    assert report(spark, DOCS, LABELS) == brute(DOCS, LABELS)


def test_a_text_with_most_rows_is_dealt_over_keys(spark, monkeypatch):
    docs = [(i, "copied text", "s") for i in range(200)] + [(i, f"text {i % 150}", "t") for i in range(200, 400)]
    monkeypatch.setattr(filter_audit, "ROWS_A_KEY", 16)
    assert report(spark, docs, LABELS) == brute(docs, LABELS)


def test_no_documents_give_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    assert report(spark, DOCS, LABELS[:0] + [(None, None, None)]) == brute(DOCS, [])


def test_own_filters(spark):
    docs = spark.createDataFrame([(1, "x", "s"), (2, "x", "s"), (3, "yy", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    out = filter_audit.audit(docs, labels, {"L": F.length("text") < 2})
    got = sorted(tuple(r) for r in out.collect())
    assert got == [("s", "EL", 1, 2, 1, 0, 0, 1, 0, 1), ("s", "EL", 2, 1, 1, 1, 1, 0, 0, 3), ("s", "LE", 1, 1, 2, 0, 1, 1, 0, 3), ("s", "LE", 2, 1, 0, 1, 0, 0, 0, 1)]
