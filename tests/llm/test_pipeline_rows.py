"""The pipeline's stages on repeated and null ids: rows are decided on by themselves, and none is lost."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline as cp
from gridclime.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row_key int"


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7) for i, t, s in rows], COLUMNS)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


A, B, C = text(1), text(2), text(3)
ROWS = [
    (1, A, "s"), (2, A, "s"), (2, B, "s"), (3, A + " more", "s"), (None, A, "t"), (None, C, "t"), (None, C, "t"), (None, text(4), None),
    (5, None, "s"), (5, "", "s"), (5, "", "s"), (6, text(5), "s"), (6, text(5) + " x", "s"), (6, text(6), "t"), (7, "one", "s"), (8, "one", "t"),
]


def test_near_duplicates_keep_one_row_of_each_group(spark):
    out = cp.near_duplicates(spark, frame(spark, ROWS), "")
    got = sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=repr)
    sets = [shingles(t) for _, t, _ in ROWS]
    group = list(range(len(ROWS)))
    for _ in ROWS:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    group[i] = group[j] = min(group[i], group[j])
    want = []
    for g in set(group):
        own = [r for r, k in zip(ROWS, group) if k == g]
        want.append(min(own, key=lambda r: (r[0] is None, r[0] or 0)))
    kept = lambda rows: sorted((r[0], r[1]) if r[1] in (None, "") else (r[0], shingles(r[1]) and r[1][:30]) for r in map(lambda r: (r[0] if r[0] is not None else -1, r[1] or ""), rows))
    assert kept(got) == kept(want) and out.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert (2, B, "s") in got and got.count((5, "", "s")) == 2 and (5, None, "s") in got


def test_decontamination_drops_only_rows_that_hold_an_item(spark, tmp_path):
    item = text(9, 20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, A, "s"), (1, f"{A} {item} {B}", "s"), (None, B, "s"), (None, f"{B} {item}", None), (2, None, "s"), (3, item, "s"), (3, C, "s"), (3, C, "s")]
    got = [(r.doc_id, r.text, r.source) for r in cp.decontamination(spark, frame(spark, rows), str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((r for r in rows if item not in (r[1] or "")), key=repr)


@pytest.mark.parametrize("docs", [ROWS, [(1, A, "s"), (None, B, "t")]])
def test_mixture_gives_each_row_its_own_words(spark, docs):
    given = frame(spark, docs)
    got = sorted(((r.doc_id, r.text, r.source, r["size"], r.taken) for r in cp.mixture(spark, given, "").collect()), key=repr)
    rows, key = cp.keyed(given)
    by_key = {}
    for r in mixing.mix(rows, id_col=key)[0].collect():
        by_key.setdefault(r[key], []).append(r.taken)
    texts = {r[key]: (r.doc_id, r.text, r.source) for r in rows.collect()}
    want = sorted(((*texts[k], len((texts[k][1] or "").split()), n) for k, found in by_key.items() for n in found if n > 0), key=repr)
    assert got == want and got


def test_keys_tell_nulls_from_empty_texts(spark):
    rows, key = cp.keyed(frame(spark, [(None, "a", "b"), (1, "a", "b"), (1, None, "b"), (1, "", "b"), (1, "a", None), (1, "a", "")]))
    assert key == "row_key_" and rows.select(key).distinct().count() == 6


def test_mixture_does_not_broadcast_a_row_for_each_document(spark):
    out = cp.mixture(spark, frame(spark, ROWS), "")
    assert out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [row_key_#" in line and "Inner" in line]
    assert joins and not any("Broadcast" in line for line in joins)
