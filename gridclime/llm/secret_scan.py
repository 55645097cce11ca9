"""Secrets in texts: fixed patterns, and spans that a linear-chain conditional random field adds.

A token is a run of letters, digits and underscores or a run of other signs. The field tags each token as the beginning
of a secret, its inside, or outside, from the token's shape and word, its neighbours and features of the whole text, and
is decoded by Viterbi over the whole text. It learns from a bounded sample of windows in which the patterns' matches are
the secrets; all but coarse features are hidden at random while it learns, so that coarse shapes and neighbours must do alone.

Defined cases: a null text is empty; texts without tokens have no spans; a null id and repeated rows are kept as they are;
no documents give no rows and a field that tags nothing. Columns other than id and text are not read. Spans are in code
points, the end exclusive. An added span never overlaps a pattern's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Tables
from .tokens import Tokens, chunks, distinct, mix, tokenise

# The kinds and their patterns, and the least length of what the last group holds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"(AKIA[A-Z0-9]+)")
# a run that is too short is dropped whole, so runs may be sought with their least length
HEX = re.compile(r"([0-9a-f]{24,})")
KINDS = ("assign", "access", "hex", "crf")
PATTERNS = (("assign", ASSIGN, 6, "=:"), ("access", ACCESS, 20, ("AKIA",)), ("hex", HEX, 24, ""))

BITS = 16
DIMENSIONS = 1 << BITS
OUT, BEGIN, INSIDE = 0, 1, 2
#: Documents the field is fitted on, about; they are taken by a hash of id and text.
FIT_DOCS = 16_000
#: Windows of a document that it learns from: around matches and made-up ones, around other tokens with digits, and anywhere.
MATCHES, MADE, NUMBERS, OTHERS = 4, 3, 2, 1
HALF = 12
SHARDS, ROUNDS, BATCH = 4, 4, 64
RATE, L2, HIDDEN = 0.3, 1e-4, 0.5
BLOCK = 1 << 16

_BYTES = np.arange(256)
_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_HIGH = _BYTES >= 128
_WORD = _DIGIT | _UPPER | _LOWER | _HIGH | (_BYTES == 95)
RUNS = np.select([_SPACE, _WORD], [0, 1], 2).astype(np.uint8)
_CLASS = np.select([_LOWER, _UPPER, _DIGIT, _HIGH], [1, 2, 3, 4], 0).astype(np.uint8)
_COUNTED = {
    "digits": _DIGIT, "upper": _UPPER, "lower": _LOWER, "high": _HIGH, "hex": _DIGIT | ((_BYTES >= 97) & (_BYTES <= 102)),
    "vowels": np.isin(_BYTES | 32, [97, 101, 105, 111, 117]) & (_UPPER | _LOWER),
}
_LENGTHS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 48, 64])
_COARSE = np.array([5, 8, 12, 16])


class Field(NamedTuple):
    """``emit[feature, tag]`` and ``move[tag, next tag]``."""

    emit: np.ndarray
    move: np.ndarray


def empty_field() -> Field:
    emit = np.zeros((DIMENSIONS + 1, 3), np.float32)
    emit[DIMENSIONS, OUT] = 1.0  # the bias
    return Field(emit, np.zeros((3, 3), np.float32))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, by start, then kind."""
    out = []
    for kind, (_, pattern, least, needs) in enumerate(PATTERNS):
        if needs and not any(n in text for n in needs):
            continue
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end() - m.start(m.lastindex) >= least]
    return sorted(out)


class Seen(NamedTuple):
    """What the features of a token are made of, by token, and the texts' bounds."""

    values: dict[str, np.ndarray]
    place: np.ndarray
    left: np.ndarray
    numeric: np.ndarray


def look(t: Tokens) -> Seen:
    """Shapes of the tokens, and the features of their text."""
    length = t.ends - t.starts
    counts = {}
    for name, member in _COUNTED.items():
        sums = np.zeros(len(t.data) + 1, np.int32)
        np.cumsum(member[t.data], out=sums[1:])
        counts[name] = (sums[t.ends] - sums[t.starts]).astype(np.int64)
    turns = np.zeros(len(t.data) + 1, np.int32)
    kind = _CLASS[t.data]
    if len(kind):
        np.cumsum(kind[1:] != kind[:-1], out=turns[1:-1])
        turns[-1] = turns[-2]
    changes = (turns[t.ends - 1] - turns[t.starts]).astype(np.int64)
    letters = counts["upper"] + counts["lower"] + counts["high"]
    mask = (
        (counts["upper"] > 0) + 2 * (counts["lower"] > 0) + 4 * (counts["digits"] > 0) + 8 * (counts["high"] > 0)
        + 16 * (counts["hex"] == length) + 32 * (t.kinds == 2)
    )
    size = np.searchsorted(_LENGTHS, length, "left")
    eighth = lambda c: 8 * c // np.maximum(1, length)
    shape = mask * 16 + size
    mixed = (counts["digits"] > 0) * 2 + (letters > 0)
    coarse = (mixed * 8 + np.searchsorted(_COARSE, length, "right")) * 4 + np.minimum(3, changes // 2)
    starts = t.starts
    prefix = np.zeros(len(starts), np.int64)
    for k in range(4):
        at = np.minimum(starts + k, len(t.data) - 1)
        prefix = prefix * 256 + np.where(starts + k < t.ends, t.data[at], 0)
    n = len(t.bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(t.bounds))
    per = np.maximum(1, np.diff(t.bounds))
    share = lambda flags: np.minimum(7, np.bincount(doc, flags, n) * 64 // per).astype(np.int64)
    file = (share(t.kinds == 2) * 8 + share(mixed == 3)) * 8 + np.minimum(7, np.log2(per) // 2).astype(np.int64)
    scattered = lambda x: mix(x.astype(np.uint64) + np.uint64(1))
    return Seen(
        {
            "coarse": scattered(coarse),
            "shape": scattered(shape),
            "form": scattered((mixed * 16 + size) * 16 + eighth(changes)),
            "texture": scattered((eighth(counts["digits"]) * 9 + eighth(counts["vowels"])) * 32 + size),
            "word": np.where(length <= 24, t.hashes, scattered(shape)),
            "prefix": scattered(prefix * 64 + size),
            "file": scattered(file[doc] * 64 + mixed * 16 + size),
        },
        np.arange(len(starts)) - t.bounds[doc],
        t.bounds[doc + 1] - np.arange(len(starts)) - 1,
        counts["digits"] > 0,
    )


#: (value, places from the token) of each feature, and two joined values; the last line of each is never hidden.
SINGLE = (
    ("shape", 0), ("form", 0), ("texture", 0), ("file", 0), ("word", 0), ("prefix", 0), ("word", -1), ("word", -2),
    ("word", -3), ("word", 1), ("shape", -1), ("shape", 1), ("coarse", -1), ("coarse", 1),
    ("coarse", 0),
)
PAIRS = (
    (("form", 0), ("word", -1)), (("form", 0), ("word", -2)), (("form", 0), ("shape", 1)),
    (("coarse", 0), ("word", -1)), (("coarse", 0), ("coarse", -1)),
)
HIDEABLE = np.array([v != "coarse" for v, _ in SINGLE] + [p[0][0] != "coarse" for p in PAIRS])
WIDTH = len(SINGLE) + len(PAIRS)


def features(seen: Seen, first: int, last: int) -> np.ndarray:
    """Feature numbers of the tokens first to last, WIDTH of each; the bias is left to the caller."""
    at = np.arange(first, last)
    out = np.empty((last - first, WIDTH), np.int32)
    cache: dict[tuple[str, int], np.ndarray] = {}

    def value(name: str, step: int) -> np.ndarray:
        if (name, step) not in cache:
            inside = seen.place[first:last] >= -step if step < 0 else seen.left[first:last] >= step
            near = np.clip(at + step, 0, len(seen.place) - 1)
            cache[name, step] = np.where(inside, seen.values[name][near], np.uint64(0)) if step else seen.values[name][first:last]
        return cache[name, step]

    shift = np.uint64(64 - BITS)
    for k, one in enumerate((*SINGLE, *PAIRS)):
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)
        if k < len(SINGLE):
            v = value(*one)
        else:
            v = mix(value(*one[0]) + np.uint64(3) * value(*one[1]))
        out[:, k] = ((v + np.uint64(k)) * odd) >> shift
    return out


def emissions(seen: Seen, field: Field) -> np.ndarray:
    """Score of each tag for each token, made block by block."""
    n = len(seen.place)
    out = np.empty((n, 3), np.float64)
    for first in range(0, n, BLOCK):
        last = min(n, first + BLOCK)
        numbers = features(seen, first, last)
        total = np.repeat(field.emit[DIMENSIONS][None].astype(np.float64), last - first, axis=0)
        for k in range(WIDTH):
            total += field.emit[numbers[:, k]]
        out[first:last] = total
    return out


def viterbi(scores: np.ndarray, move: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Best tags of each sequence ``bounds[i]:bounds[i + 1]``; of equal ones the smaller tag at the last place they differ.

    A token is outside for certain when putting it outside gains more than its two moves can lose, whatever its
    neighbours are. Between such tokens, the remaining runs are decoded together, one step of all runs at a time.
    """
    move = move.astype(np.float64)
    n = len(scores)
    tags = np.zeros(n, np.int8)
    certain = np.ones(n, bool)
    for y in (BEGIN, INSIDE):
        loss = (move[:, y] - move[:, OUT]).max() + (move[y] - move[OUT]).max()
        certain &= scores[:, OUT] - scores[:, y] > max(0.0, loss, (move[:, y] - move[:, OUT]).max(), (move[y] - move[OUT]).max())
    open_ = np.flatnonzero(~certain)
    if not len(open_):
        return tags
    heads = np.zeros(n + 1, bool)
    heads[bounds] = True
    new = np.ones(len(open_), bool)
    new[1:] = (np.diff(open_) > 1) | heads[open_[1:]]
    first = open_[new]
    length = np.diff(np.append(np.flatnonzero(new), len(open_)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    after = first + length
    state = scores[first] + np.where(heads[first][:, None], 0.0, move[OUT][None])
    final = np.zeros((len(first), 3))
    back, going = [], len(first)
    step = 1
    while True:
        still = int(np.searchsorted(-length, -step, "left"))  # runs longer than step
        ended = slice(still, going)
        final[ended] = state[ended] + np.where(heads[after[ended]][:, None], 0.0, move[:, OUT][None])
        if not still:
            break
        paths = state[:still, :, None] + move[None]
        came = paths.argmax(axis=1)
        state = np.take_along_axis(paths, came[:, None, :], axis=1)[:, 0] + scores[first[:still] + step]
        back.append(came.astype(np.int8))
        going, step = still, step + 1
    tag = final.argmax(axis=1)
    for step in range(int(length[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-length, -step, "left"))
        tags[first[:alive] + step] = tag[:alive]
        if step:
            tag[:alive] = back[step - 1][np.arange(alive), tag[:alive]]
    return tags


def tagged(t: Tokens, field: Field) -> list[list[tuple[int, int]]]:
    """Byte spans, from the start of the chunk, that the field finds in each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(t.bounds) - 1)]
    if not len(t.starts):
        return out
    tags = viterbi(emissions(look(t), field), field.move, t.bounds)
    hit = np.flatnonzero(tags)
    doc = np.searchsorted(t.bounds, hit, "right") - 1
    last = None
    for i, d in zip(hit.tolist(), doc.tolist()):
        if tags[i] == INSIDE and last == (i - 1, d):
            out[d][-1] = (out[d][-1][0], int(t.ends[i]))
        else:
            out[d].append((int(t.starts[i]), int(t.ends[i])))
        last = (i, d)
    return out


def in_points(data: np.ndarray, at: list[int]) -> list[int]:
    """Code points before each byte place."""
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return before[at].tolist()


def field_spans(column: pa.Array, field: Field) -> Iterator[list[tuple[int, int]]]:
    """Code point spans that the field alone finds in each text."""
    for _, _, data, offsets in chunks(column):
        for i, spans in enumerate(tagged(tokenise(data, offsets, RUNS), field)):
            own = data[offsets[i] : offsets[i + 1]]
            ends = in_points(own, [p - int(offsets[i]) for s in spans for p in s]) if spans else []
            yield list(zip(ends[::2], ends[1::2]))


def apart(own: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end) in order that overlap none of the spans (start, kind, end)."""
    out, reach, i = [], 0, 0
    for s, e in own:
        while i < len(base) and base[i][0] < e:  # begins before this span's end
            reach, i = max(reach, base[i][2]), i + 1
        if reach <= s:
            out.append((s, e))
    return out


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of each row; a span is (kind, start, end), ordered by start, then kind as in KINDS."""
    given = docs.sparkSession.sparkContext.broadcast(tuple(field))
    given_rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    span = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")
    out = T.StructType().add("id", given_rows.schema["id"].dataType).add("spans", T.ArrayType(span))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*given.value)
        for batch in batches:
            rows = []
            for text, own in zip(batch.column(1), field_spans(batch.column(1), field)):
                found = base_spans(text.as_py())
                added = [(s, len(PATTERNS), e) for s, e in apart(own, found)]
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(found + added)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, arrow)], ["id", "spans"])

    return given_rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def relettered(rng: np.random.Generator) -> str:
    """A made-up secret of letters of one or both cases and digits, with or without a word in front."""
    alphabet = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")[rng.integers(3)]
    n = int(rng.integers(12, 45))
    digit = rng.random(n) < rng.uniform(0.1, 0.5)
    body = "".join(str(rng.integers(10)) if d else alphabet[rng.integers(len(alphabet))] for d in digit)
    front = "".join(alphabet[rng.integers(26)] for _ in range(rng.integers(2, 6))) + "_" if rng.random() < 0.3 else ""
    return front + body


def secret_parts(text: str) -> list[tuple[int, int]]:
    """Where the patterns' last groups are."""
    found = [
        (m.start(m.lastindex), m.end())
        for _, pattern, least, _ in PATTERNS for m in pattern.finditer(text) if m.end() - m.start(m.lastindex) >= least
    ]
    return sorted(set(found))


def window(t: Tokens, seen: Seen, doc: int, tags: np.ndarray, centre: int) -> tuple[bytes, bytes]:
    """(feature numbers, tags) of the tokens about the centre-th token of a text."""
    x, y = max(0, centre - HALF), min(len(tags), centre + HALF + 1)
    first = int(t.bounds[doc])
    return features(seen, first + x, first + y).tobytes(), tags[x:y].tobytes()


def tag_parts(starts: np.ndarray, ends: np.ndarray, parts: list[tuple[int, int]]) -> tuple[np.ndarray, list[int]]:
    """Tags of a text's tokens, given where secrets are, and the tokens that begin one."""
    tags, heads = np.zeros(len(starts), np.int8), []
    for a, b in parts:
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if first < last:
            tags[first:last] = INSIDE
            tags[first] = BEGIN
            heads.append(first)
    return tags, heads


def sample_windows(column: pa.Array) -> Iterator[tuple[bytes, bytes]]:
    """(feature numbers, tags) of the windows that texts give to learn from.

    Around a match there are four: as it is, with a made-up secret of another alphabet and length in its place, and with
    such secrets in the place of other words of the text.
    """
    row = 0
    for _, _, data, offsets in chunks(column):
        t = tokenise(data, offsets, RUNS)
        seen = look(t) if len(t.starts) else None
        for i in range(len(offsets) - 1):
            a, b = int(t.bounds[i]), int(t.bounds[i + 1])
            text, row = column[row].as_py() or "", row + 1
            if a == b:
                continue
            own = data[offsets[i] : offsets[i + 1]]
            before = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            parts = secret_parts(text)
            tags, heads = tag_parts(before[t.starts[a:b] - offsets[i]], before[t.ends[a:b] - offsets[i]], parts)
            rank = mix(np.arange(b - a).astype(np.uint64) + t.hashes[a:b])
            numbers, anywhere = np.flatnonzero((tags == 0) & seen.numeric[a:b]), np.flatnonzero(tags == 0)
            centres = sorted(set(heads), key=lambda c: int(rank[c]))[:MATCHES]
            centres += numbers[np.argsort(rank[numbers])][:NUMBERS].tolist()
            centres += anywhere[np.argsort(rank[anywhere])][:OTHERS].tolist()
            for c in distinct(np.array(centres, np.int64)).tolist():
                yield window(t, seen, i, tags, c)
            rng = np.random.default_rng(int(rank[0]))
            starts, ends = t.starts[a:b] - offsets[i], t.ends[a:b] - offsets[i]
            raw = own.tobytes()
            for head in sorted(set(heads), key=lambda c: int(rank[c]))[:MATCHES]:
                elsewhere = rng.choice(anywhere, MADE - 1).tolist() if len(anywhere) else []
                for c in [head, *elsewhere]:
                    x, y = max(0, c - 2 * HALF), min(b - a, c + 2 * HALF) - 1
                    left, new = raw[starts[x] : starts[c]], relettered(rng).encode()
                    about = left + new + raw[ends[c] : ends[y]]
                    u = tokenise(np.frombuffer(about, np.uint8), np.array([0, len(about)]), RUNS)
                    other, begins = tag_parts(u.starts, u.ends, [(len(left), len(left) + len(new))])
                    yield window(u, look(u), 0, other, begins[0])


def marginals(scores: np.ndarray, move: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the sum over all taggings, tag probabilities, expected moves) of sequences scores[i, :sum(real[i])]."""
    n, steps, _ = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    total = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for s in range(1, steps):
        new = total(forward[:, s - 1, :, None] + move, 1) + scores[:, s]
        forward[:, s] = np.where(real[:, s, None], new, forward[:, s - 1])
    for s in range(steps - 2, -1, -1):
        new = total(move + (scores[:, s + 1] + backward[:, s + 1])[:, None, :], 2)
        backward[:, s] = np.where(real[:, s + 1, None], new, 0.0)
    whole = total(forward[:, -1], 1)
    tag = np.exp(forward + backward - whole[:, None, None]) * real[:, :, None]
    pair = forward[:, :-1, :, None] + move + (scores[:, 1:] + backward[:, 1:])[:, :, None, :]
    pair = np.exp(np.where(real[:, 1:, None, None], pair - whole[:, None, None, None], -np.inf))
    return whole, tag, pair.sum(axis=(0, 1))


def gradient(field: Field, at: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient of emit by token, gradient of move) of windows; tags are -1 beyond a window's end, and feature
    numbers -1 are hidden."""
    real = tags >= 0
    shown = at >= 0
    scores = (field.emit[np.where(shown, at, 0)].astype(np.float64) * shown[..., None]).sum(axis=2) + field.emit[DIMENSIONS]
    move = field.move.astype(np.float64)
    whole, tag, moves = marginals(scores, move, real)
    gold = (tags[:, :, None] == np.arange(3)) * 1.0
    follows = real[:, 1:]
    steps = np.zeros((3, 3))
    np.add.at(steps, (tags[:, :-1][follows], tags[:, 1:][follows]), 1.0)
    loss = whole.sum() - (scores * gold).sum() - (steps * move).sum()
    return loss, tag - gold, moves - steps


def learn(field: Field, squares: list[np.ndarray], windows: list[tuple[np.ndarray, np.ndarray]], rng) -> Field:
    """One pass over the windows (feature numbers, tags) with steps scaled by the root of squared gradients.

    The penalty is scaled likewise, so words that few windows show fall back to nothing and coarse features carry the rest.
    """
    emit, move = field.emit.astype(np.float64), field.move.astype(np.float64)
    order = rng.permutation(len(windows))
    for first in range(0, len(order), BATCH):
        batch = [windows[i] for i in order[first : first + BATCH]]
        steps = max(len(y) for _, y in batch)
        at = np.full((len(batch), steps, WIDTH), -1, np.int32)
        tags = np.full((len(batch), steps), -1, np.int8)
        for i, (x, y) in enumerate(batch):
            at[i, : len(y)], tags[i, : len(y)] = x, y
        at[(rng.random(at.shape) < HIDDEN) & HIDEABLE] = -1
        _, by_token, by_move = gradient(Field(emit, move), at, tags)
        shown = at >= 0
        g = np.empty_like(emit)
        for k in range(3):
            each = np.broadcast_to(by_token[:, :, None, k], at.shape)[shown]
            g[:, k] = np.bincount(at[shown], each, DIMENSIONS + 1)
            g[DIMENSIONS, k] = by_token[:, :, k].sum()
        for weights, slope, square in ((emit, g, squares[0]), (move, by_move, squares[1])):
            slope = slope / len(batch) + L2 * weights
            square += slope * slope
            weights -= RATE * slope / (np.sqrt(square) + 1e-6)
    return Field(emit.astype(np.float32), move.astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> Field:
    """The field, fitted on windows of about ``fit_docs`` documents taken by a hash of id and text.

    Each round, shards of the windows start from the common weights and pass over their windows once; Spark's tasks
    return one state each, of a size that the parameters fix, and the states are averaged.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "secrets")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.col(id_col).cast("string"), text)
    share = fit_docs / max(1, docs.count())
    given = docs.select(key.alias("key"), text.alias("text")).where(F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30)))
    # equal rows have equal keys, so copies of a row cannot fill the sample
    given = given.dropDuplicates(["key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                own = list(sample_windows(batch.column(1).slice(i, 1)))
                if own:
                    key = batch.column(0).slice(i, 1).to_pylist() * len(own)
                    columns = [pa.array(key, pa.int64()), pa.array([x for x, _ in own], pa.binary()), pa.array([y for _, y in own], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "at", "tags"])

    cut_rows = given.mapInArrow(cut, "key long, at binary, tags binary")
    windows = tables.save(cut_rows.withColumn("shard", F.pmod("key", F.lit(SHARDS))), "windows")
    field, squares = empty_field(), [np.zeros((DIMENSIONS + 1, 3)), np.zeros((3, 3))]
    for number in range(rounds):
        state = spark.sparkContext.broadcast((tuple(field), squares))

        def update(table: pa.Table) -> pa.Table:
            (emit, move), squares = state.value
            squares = [s.copy() for s in squares]
            shard = table.column("shard")[0].as_py()
            rows = sorted(zip(table.column("key").to_pylist(), table.column("at").to_pylist(), table.column("tags").to_pylist()))
            own = [(np.frombuffer(x, np.int32).reshape(-1, WIDTH), np.frombuffer(y, np.int8)) for _, x, y in rows]
            new = learn(Field(emit, move), squares, own, np.random.default_rng([number, shard]))
            parts = [new.emit, new.move, *(s.astype(np.float32) for s in squares)]
            return pa.table({"shard": [shard], "parts": [[p.tobytes() for p in parts]]})

        found = sorted(windows.groupBy("shard").applyInArrow(update, "shard long, parts array<binary>").collect())
        state.unpersist()
        if not found:
            break
        mean = [np.mean([np.frombuffer(r.parts[i], np.float32) for r in found], axis=0).reshape(-1, 3) for i in range(4)]
        field, squares = Field(*mean[:2]), [m.astype(np.float64) for m in mean[2:]]
    tables.drop("windows")
    return field
