"""op12: patterns, the field's sums and decoding against enumeration, and the whole query against plain matching."""

from __future__ import annotations

import hashlib
import re
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from gridclime.llm import secret_scan as s
from gridclime.llm.queries import op12_secret_scan
from gridclime.llm.tokens import tokenise

SF_DIR = "/root/testdata/sf0.01"


def plain(text):
    """(start, kind, end) by the contract's words: match everything, drop failing matches."""
    rules = (
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in p.finditer(text or "") if ok(m))


@pytest.mark.parametrize(
    "text",
    [
        "", "password=abcdef", "password=abcde", "PassWord' : \"abc=.-/+_9", "token=token=abcdefgh", "token:token:abcdefgh", "apikey = x1y2z3 api_key:'q'",
        "AKIA" + "A" * 16, "AKIA" + "A" * 15, "AKIAkAKIA" + "B" * 20, "xAKIAAKIA" + "C" * 16 + "é", "0" * 24, "g" + "f" * 23, "é" * 30 + "ab" * 12 + "g",
        "ſecret=abcdefgh", "toKen=abcdefgh", "token=\tabcdefgh", "secret  :  ==abcd secret=" + "a1" * 20,
    ],
)
def test_patterns(text):
    assert s.base_spans(text) == plain(text)


def walks(scores, move):
    for tags in product(range(3), repeat=len(scores)):
        yield sum(x[t] for x, t in zip(scores, tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:])), tags


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 8, 12)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(0, 2, (bounds[-1], 3)) + np.array([rng.integers(0, 6), 0, 0])
    move = rng.normal(0, 1, (3, 3))
    got = s.viterbi(scores, move, bounds)
    for a, b in zip(bounds[:-1], bounds[1:]):
        assert tuple(got[a:b]) == max(walks(scores[a:b], move))[1]


def test_viterbi_with_equal_scores_takes_outside():
    assert s.viterbi(np.zeros((6, 3)), np.zeros((3, 3)), np.array([0, 0, 4, 4, 6, 6])).tolist() == [0] * 6
    assert s.viterbi(np.zeros((0, 3)), np.zeros((3, 3)), np.array([0, 0])).tolist() == []


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    scores, move = rng.normal(0, 1, (3, 5, 3)), rng.normal(0, 1, (3, 3))
    real = np.arange(5) < np.array([5, 3, 1])[:, None]
    whole, tag, moves = s.marginals(scores, move, real)
    expected = np.zeros((3, 3))
    for i in range(3):
        n = real[i].sum()
        weights = [(np.exp(v), t) for v, t in walks(scores[i, :n], move)]
        z = sum(w for w, _ in weights)
        assert np.isclose(whole[i], np.log(z))
        for k in range(n):
            assert np.allclose(tag[i, k], [sum(w for w, t in weights if t[k] == y) / z for y in range(3)])
        assert not tag[i, n:].any()
        for w, t in weights:
            for a, b in zip(t, t[1:]):
                expected[a, b] += w / z
    assert np.allclose(moves, expected)


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    field = s.Field(rng.normal(0, 0.5, (s.DIMENSIONS + 1, 3)), rng.normal(0, 0.5, (3, 3)))
    at = rng.integers(0, 50, (2, 4, s.WIDTH))
    at[0, 1, :5] = -1
    tags = np.array([[0, 1, 2, 0], [1, 0, -1, -1]], np.int8)
    _, by_token, by_move = s.gradient(field, at, tags)
    step = 1e-5
    for place in ((0, 1), (1, 2), (2, 0)):
        other = field.move.copy()
        other[place] += step
        high = s.gradient(field._replace(move=other), at, tags)[0]
        other[place] -= 2 * step
        assert np.isclose(by_move[place], (high - s.gradient(field._replace(move=other), at, tags)[0]) / (2 * step), atol=1e-4)
    for f, y in ((int(at[0, 0, 0]), 0), (int(at[1, 1, 3]), 1), (s.DIMENSIONS, 2)):
        slope = by_token[:, :, y].sum() if f == s.DIMENSIONS else ((at == f) * by_token[:, :, None, y]).sum()
        other = field.emit.copy()
        other[f, y] += step
        high = s.gradient(field._replace(emit=other), at, tags)[0]
        other[f, y] -= 2 * step
        assert np.isclose(slope, (high - s.gradient(field._replace(emit=other), at, tags)[0]) / (2 * step), atol=1e-4)


def test_features_do_not_depend_on_other_texts_or_blocks():
    texts = ["key = 'a1b2' é", "x", "", "one two3 four_5 – six:7"]
    every = s.look(tokenise(*_bytes(texts), s.RUNS))
    alone = [s.look(tokenise(*_bytes([t]), s.RUNS)) for t in texts]
    n = len(every.place)
    whole = s.features(every, 0, n)
    assert (whole == np.concatenate([s.features(a, 0, len(a.place)) for a in alone])).all()
    assert (whole == np.concatenate([s.features(every, i, i + 1) for i in range(n)])).all()


def _bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.fixture(scope="module")
def field(spark):
    return s.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 > 0"))


def test_field_finds_secrets_that_no_pattern_knows(field):
    hidden = {
        'my passphrase = "b7db7aa4a5fcc78305d1" and': "b7db7aa4a5fcc78305d1", "é auth: ghp_16C7e42F292c6912E7710c838347Ae178B4a end": "ghp_16C7e42F292c6912E7710c838347Ae178B4a",
        "client_id=8f14e45fceea167a5a3": "8f14e45fceea167a5a3",
    }
    clean = [
        "Mail bob.12@corp3.example or 743-555-3824 in 2024.", "plain words are here, and 12345 too", "order 20240101-4455 of 2024-01-01 at 10:20", "", "£ 1,000.50",
    ]
    found = list(s.field_spans(pa.array([*hidden, *clean]), field))
    got = [[t[a:b] for a, b in spans] for t, spans in zip(hidden, found)]
    assert sum(g == [want] for g, want in zip(got, hidden.values())) >= 2
    assert all(f == [] for f in found[len(hidden) :])
    assert not any(s.base_spans(t) for t in hidden)


def test_field_agrees_with_patterns_on_other_documents(spark, field):
    """The field alone, on documents it was not fitted on."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 = 0").select("text").collect()
    texts = [r.text or "" for r in rows]
    want = [set(s.secret_parts(t)) for t in texts]
    got = [set(f) for f in s.field_spans(pa.array(texts), field)]
    right = sum(len(w & g) for w, g in zip(want, got))
    assert sum(map(len, want)) > 50 and right >= 0.9 * max(sum(map(len, want)), sum(map(len, got)))


def test_whole_query(spark):
    got = {r.doc_id: r for r in op12_secret_scan(spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        spans, r = plain(d.text), got[d.doc_id]
        digest = ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("crf")) == digest


def test_defined_cases(spark, field):
    long = "plain words " * 60_000 + "password=a1b2c3d4e5"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "!!"), (None, "token=abcdef1"), (5, "token=abcdef1"), (5, "token=abcdef1"), (6, long)]
    names = "doc_id long, text string, spans string, id int, kind int, start int, key int, shard int, tags int"
    docs = spark.createDataFrame([(*r, "x", 1, 1, 1, 1, 1, 1) for r in rows], names)
    out = s.scan(docs, field)
    got = sorted(((r.doc_id is None, r.doc_id or 0, [tuple(x) for x in r.spans]) for r in out.collect()))
    one = [("assign", 0, 13)]
    assert got == [
        (False, 1, []), (False, 2, []), (False, 3, []), (False, 4, []), (False, 5, one), (False, 5, one),
        (False, 6, [("assign", len(long) - 19, len(long))]), (True, 0, one),
    ]
    nothing = docs.where("false")
    untrained = s.train(nothing)
    assert s.scan(nothing, untrained).collect() == []
    assert list(s.field_spans(pa.array(["token=abcdef1", None]), untrained)) == [[], []]
    assert s.train(docs).emit.shape == untrained.emit.shape


def test_added_spans_overlap_no_pattern():
    base = [(0, 0, 10), (5, 2, 30), (40, 1, 60)]
    assert s.apart([(10, 12), (30, 33), (33, 41), (60, 61), (70, 80)], base) == [(30, 33), (60, 61), (70, 80)]
