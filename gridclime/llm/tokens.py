"""Vectorised tokens of Arrow string columns: runs of bytes of one class, hashed without a Python object per token."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
CHUNK_BYTES = 1 << 18


class _Powers:
    """BASE**(i + 1) and BASE**-(i + 1) modulo 2**64, so that a token's hash does not depend on where it stands."""

    def __init__(self):
        self.size, self.up, self.down = CHUNK_BYTES, None, None

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        if self.up is None:
            self.up = np.cumprod(np.full(self.size, BASE, np.uint64))
            self.down = np.cumprod(np.full(self.size, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64))
        return self.up, self.down

    def __reduce__(self):  # made anew in each task rather than sent
        return _Powers, ()


POWERS = _Powers()

_BYTES = np.arange(256)
_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

#: Classes of bytes; 0 separates tokens, a token is a run of one other class.
WORDS = np.where(_SPACE, 0, 1).astype(np.uint8)
ALNUM = np.where(_LETTER | _DIGIT, 1, 0).astype(np.uint8)
MIXED = np.select([_SPACE, _LETTER, _DIGIT], [0, 1, 2], 3).astype(np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokens(NamedTuple):
    """Tokens of the documents of a chunk: document i has tokens bounds[i]:bounds[i + 1]."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    kinds: np.ndarray
    bounds: np.ndarray


def release() -> None:
    """Give what earlier batches freed back to the system; a Python worker lives on when its task has ended."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, row offsets in them) of about chunk_bytes each; a longer text is a chunk of its own."""
    release()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        wide = np.int64
    else:
        wide = np.int32
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def tokenise(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: np.ndarray = LOWER) -> Tokens:
    """Tokens of each document by byte class, hashed after folding each byte."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Tokens(data, np.zeros(0, np.uint64), empty, empty, np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64))
    kinds = table[data]
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
    inside = offsets[offsets < n]
    edge[inside] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    up, down = POWERS.get()
    value = fold.astype(np.uint64)[data]
    value += np.uint64(1)
    if n <= len(up):
        value *= up[:n]
        hashes = np.add.reduceat(value, starts) * down[starts]
    else:  # one very long text
        lengths = ends - starts
        value *= np.cumprod(np.full(int(lengths.max()), BASE, np.uint64))[np.arange(n) - np.repeat(starts, lengths)]
        hashes = np.add.reduceat(value, starts) * down[0]
    keep = kinds[starts] > 0
    starts, ends, hashes = starts[keep], ends[keep], hashes[keep]
    hashes = mix(hashes + (ends - starts).astype(np.uint64))
    return Tokens(data, hashes, starts, ends, kinds[starts], np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` tokens, by its first token; the caller drops those that leave their document."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    factor = 1
    for k in range(width):
        factor = factor * int(BASE) % (1 << 64)
        out += hashes[k : len(hashes) - width + 1 + k] * np.uint64(factor)
    return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def shingle_sets(tokens: Tokens, width: int) -> list[np.ndarray]:
    """Distinct shingles of each document as sorted 63-bit hashes; of fewer words, the whole sequence is one shingle."""
    runs = windows(tokens.hashes, width)
    out = []
    for a, b in zip(tokens.bounds[:-1].tolist(), tokens.bounds[1:].tolist()):
        if b - a >= width:
            own = runs[a : b - width + 1]
        elif b > a:
            own = mix(windows(tokens.hashes[a:b], b - a) + np.uint64(b - a))
        else:
            own = runs[:0]
        out.append(distinct(own >> np.uint64(1)).astype(np.int64))
    return out
