"""Benchmark decontamination by spaced seeds: masks that ignore some token positions, then a check of the overlap.

Items too short for a mask are joined by the hash of their whole token run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Tables, bit_filter, in_filter
from .tokens import ALNUM, BASE, chunks, mix, tokenise, windows

#: Fixed masks over 11 tokens; a token under 0 may differ.
MASKS = ("11101001011", "11010011101", "10111100011")
SPAN = len(MASKS[0])
FILTER_BITS = 1 << 24
#: Fewest tokens of an item that counts as evidence.
LEAST = 5


def seed_hashes(hashes: np.ndarray) -> np.ndarray:
    """(mask, start) hashes of the tokens under each mask; starts of which the span leaves the array are not there."""
    n = len(hashes) - SPAN + 1
    if n <= 0:
        return np.zeros((len(MASKS), 0), np.int64)
    out = np.zeros((len(MASKS), n), np.uint64)
    for m, mask in enumerate(MASKS):
        factor = m + 1
        for k, bit in enumerate(mask):
            if bit == "1":
                factor = factor * int(BASE) % (1 << 64)
                out[m] += hashes[k : k + n] * np.uint64(factor)
    return mix(out).astype(np.int64)


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each whole run of ``width`` tokens, by its first token; different widths have different hashes."""
    return mix(windows(hashes, width) + np.uint64(width)).astype(np.int64)


def second(h: np.ndarray) -> np.ndarray:
    """Another hash of a hash, for the second test of the filter."""
    return mix(h.astype(np.uint64) + np.uint64(0x51ED270B)).astype(np.int64)


def best_overlap(same: np.ndarray, penalty: int = 3) -> tuple[int, int, int]:
    """(first, end, matches) of the stretch with the highest score of 1 a match and -penalty a substitution."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -penalty))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    first = int(np.argmin(total[: end + 1]))
    return first, end, int(same[first:end].sum())


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 13,
    least: int = LEAST,
) -> DataFrame:
    """(id, item, first_word, n_words, n_same): overlaps of documents with benchmark items, the best one of each pair.

    Tokens are runs of letters and digits of the lower-cased text. An overlap counts when it holds ``words`` equal
    tokens, or 0.8 of the item if it is shorter than that; substituted tokens are allowed in it at a third of the equal
    ones. An item of fewer tokens than SPAN counts when a document holds all of it, token by token. Items of fewer than
    ``least`` tokens, null ones too, are no evidence and match nothing; null and empty
    documents have no overlap; repeated documents give equal rows once. Other columns are ignored.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "decontaminate")

    def items_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs, seeds, places = [], [], [], []
            for first, _, data, offsets in chunks(batch.column(1)):
                t = tokenise(data, offsets, ALNUM)
                for i, (a, b) in enumerate(zip(t.bounds[:-1], t.bounds[1:])):
                    if b - a >= least:
                        s = seed_hashes(t.hashes[a:b]) if b - a >= SPAN else np.zeros((0, 0), np.int64)
                        ids.append(batch.column(0)[first + i].as_py())
                        blobs.append(t.hashes[a:b].tobytes())
                        seeds.append(s.ravel())
                        places.append(np.tile(np.arange(s.shape[1], dtype=np.int32), len(MASKS)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(blobs, pa.binary()), pa.array(seeds, pa.list_(pa.int64())),
                 pa.array([second(s) for s in seeds], pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                ["item", "item_tokens", "seeds", "seconds", "places"],
            )

    text = lambda c: F.lower(F.col(c).cast("string")).alias("text")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), text(item_text_col))
    items = tables.save(
        items.mapInArrow(items_of, "item long, item_tokens binary, seeds array<long>, seconds array<long>, places array<int>"), "items"
    )
    seeds = items.select("item", F.explode(F.arrays_zip("seeds", "seconds", "places")).alias("s")).select(
        "item", F.col("s.seeds").alias("seed"), F.col("s.seconds").alias("second"), F.col("s.places").alias("place")
    )
    reach = items.agg(F.max(F.octet_length("item_tokens"))).first()[0]
    reach = (reach or 0) // 8
    one, two = bit_filter(seeds, "seed", FILTER_BITS), bit_filter(seeds, "second", FILTER_BITS)

    def short_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([int(run_hashes(v, len(v))[0]) for v in runs], pa.int64()), pa.array([len(v) for v in runs], pa.int64())],
                ["item", "run", "width"],
            )

    short = items.where(F.octet_length("item_tokens") < 8 * SPAN).select("item", "item_tokens")
    short = tables.save(short.mapInArrow(short_items, "item long, run long, width long").distinct(), "short")
    widths = sorted(r.width for r in short.select("width").distinct().collect())
    whole = bit_filter(short, "run", FILTER_BITS) if widths else None

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First place of each run of a document that may be a short item, by the filter."""
        for batch in batches:
            docs_, runs, places = [], [], []
            for first, _, data, offsets in chunks(batch.column(1)):
                t = tokenise(data, offsets, ALNUM)
                for w in widths:
                    h = run_hashes(t.hashes, w)
                    at = np.flatnonzero(in_filter(whole, h))
                    doc = np.searchsorted(t.bounds, at, "right") - 1
                    inside = at + w <= t.bounds[doc + 1]
                    at, doc = at[inside], doc[inside]
                    if not len(at):
                        continue
                    _, once = np.unique(np.stack([doc, h[at]]), axis=1, return_index=True)
                    docs_ += (first + doc[once]).tolist()
                    runs += h[at[once]].tolist()
                    places += (at - t.bounds[doc])[once].tolist()
            ids = batch.column(0).take(pa.array(docs_, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(runs, pa.int64()), pa.array(places, pa.int64())], ["id", "run", "place"])

    def regions_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of documents around the places where a seed passes the filters."""
        names = ["id", "key", "start", "tokens", "at", "seed"]
        for batch in batches:
            rows = []
            for first, _, data, offsets in chunks(batch.column(1)):
                t = tokenise(data, offsets, ALNUM)
                s = seed_hashes(t.hashes)
                mask, at = np.nonzero(in_filter(one, s))
                keep = in_filter(two, second(s[mask, at]))
                mask, at = mask[keep], at[keep]
                doc = np.searchsorted(t.bounds, at, "right") - 1
                inside = at + SPAN <= t.bounds[doc + 1]
                mask, at, doc = mask[inside], at[inside], doc[inside]
                order = np.argsort(at, kind="stable")
                mask, at, doc = mask[order], at[order], doc[order]
                cut = np.flatnonzero((np.diff(doc) > 0) | (np.diff(at) > reach)) + 1
                for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])):
                    if a == b:
                        continue
                    d = int(doc[a])
                    low = max(int(t.bounds[d]), int(at[a]) - reach)
                    high = min(int(t.bounds[d + 1]), int(at[b - 1]) + SPAN + reach)
                    region = t.hashes[low:high]
                    start = low - int(t.bounds[d])
                    with np.errstate(over="ignore"):
                        key = mix(np.add.reduce(mix(region * np.uint64(3) + np.arange(len(region), dtype=np.uint64))) + np.uint64(start))
                    rows.append((
                        batch.column(0)[first + d].as_py(), int(key >> np.uint64(1)), start, region.tobytes(), at[a:b] - low, s[mask[a:b], at[a:b]],
                    ))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for id_, start, item, shift, tokens, item_tokens in zip(*(b.column(i) for i in range(6))):
                u, v = (np.frombuffer(x.as_buffer(), np.uint64) for x in (tokens, item_tokens))
                k = shift.as_py()
                low, high = max(0, k), min(len(u), k + len(v))
                first, end, n = best_overlap(u[low:high] == v[low - k : high - k])
                if n >= min(words, -(-4 * len(v) // 5)):
                    out.append((id_.as_py(), item.as_py(), start.as_py() + low + first, end - first, n))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["id", "item", "first_word", "n_words", "n_same"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text(text_col))
    regions = rows.mapInArrow(regions_of, "id long, key long, start long, tokens binary, at array<long>, seed array<long>")
    regions = tables.save(regions, "regions").dropDuplicates(["id", "key"])
    hits = regions.select("id", "key", F.explode(F.arrays_zip("at", "seed")).alias("h")).select("id", "key", F.col("h.at").alias("at"), F.col("h.seed").alias("seed"))
    lines = hits.join(seeds, "seed").select("id", "key", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    lines = lines.join(items.select("item", "item_tokens"), "item").join(regions.select(F.col("id").alias("i"), "key", "start", "tokens"), "key")
    lines = lines.where(F.col("id").eqNullSafe(F.col("i"))).select("id", "start", "item", "shift", "tokens", "item_tokens")
    found = lines.mapInArrow(verified, "id long, item long, first_word long, n_words long, n_same long")
    if widths:
        # a hash of 64 bits over all tokens of the item stands for their equality
        held = rows.mapInArrow(runs_of, "id long, run long, place long").join(short, "run")
        found = found.unionByName(held.select("id", "item", F.col("place").alias("first_word"), F.col("width").alias("n_words"), F.col("width").alias("n_same")))
    best = found.groupBy("id", "item").agg(F.max(F.struct("n_same", (-F.col("first_word")).alias("back"), "n_words")).alias("b"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.back")).alias("first_word"),
        F.col("b.n_words").alias("n_words"), F.col("b.n_same").alias("n_same"),
    )
