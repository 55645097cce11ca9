"""Mixing sources to target weights: fixed-length blocks of words, drawn by shards through keyed permutations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Tables, tasks_for

WEIGHTS = (5, 2, 1)
#: Words of a block.
BLOCK_WORDS = 128
#: Slots of an output shard.
SHARD_SLOTS = 8192
#: Rows of draws that the driver holds at a time.
DRAWS_EACH = 1 << 18
#: Figures of a source.
ABOUT = pa.schema([
    ("number", pa.int64()), ("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()),
    ("blocks", pa.int64()), ("slots", pa.int64()), ("cut", pa.int64()),
])


def word_count(text: Column) -> Column:
    """Runs of bytes other than white space; 0 for null."""
    return F.coalesce(F.expr("size(regexp_extract_all({}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0))".format("`_text`")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """share of all sizes dealt by weight (repeating); none above ``most`` times its size, the excess dealt anew by weight."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    size = np.array(sizes, float)
    cap, goal = most * size, np.zeros(len(sizes))
    open_ = size > 0
    left = share * size.sum()
    while open_.any() and left > 0:
        goal[open_] = left * w[open_] / w[open_].sum()
        over = open_ & (goal > cap)
        if not over.any():
            break
        goal[over] = cap[over]
        left -= cap[over].sum()
        open_ &= ~over
    return goal.tolist()


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each k in 0..n-1 under the permutation of 0..n-1 that belongs to its key: a Feistel network that walks cycles."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.astype(np.uint64), np.ones(len(k), bool)
    key = key.astype(np.uint64)
    while todo.any():
        x, h, m, s = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(6):
            f = (right + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) ^ s
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo &= out >= n.astype(np.uint64)
    return out.astype(np.int64)


def source_key(source: str | None, epoch: int, seed: int) -> int:
    text = "n" if source is None else "s" + source
    return int(pd.util.hash_array(np.array([f"{seed}/{epoch}/{text}"], object))[0] >> np.uint64(1))


def shard_counts(slots: np.ndarray, shard_slots: int, seed: int) -> Iterator[np.ndarray]:
    """Slots of each source, shard by shard: multinomial draws by what each source has left, and never more than that."""
    left = slots.astype(np.int64)
    random = np.random.default_rng(seed)
    while (total := int(left.sum())) > 0:
        n = min(shard_slots, total)
        draw = np.zeros_like(left)
        while (need := n - int(draw.sum())) > 0:
            rest = left - draw
            draw += np.minimum(random.multinomial(need, rest / rest.sum()), rest)
        yield draw
        left = left - draw


def draw_tables(counts: Iterator[np.ndarray], sources: int, rows_each: int = DRAWS_EACH) -> Iterator[pa.Table]:
    """Rows (shard, number, k, n): n slots of a source, from its k-th on, are in a shard. Tables of about ``rows_each``, one at least."""
    parts, held, start = [], 0, np.zeros(sources, np.int64)

    def joined() -> pa.Table:
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4)]
        return pa.table(dict(zip(("shard", "number", "k", "n"), columns)))

    for shard, draw in enumerate(counts):
        number = np.flatnonzero(draw)
        if held and held + len(number) > rows_each:
            yield joined()
            parts, held = [], 0
        parts.append((np.full(len(number), shard), number, start[number], draw[number]))
        held += len(number)
        start += draw
    yield joined()


def place_words(docs: DataFrame, tables: Tables, rows_each: int = 4000) -> DataFrame:
    """docs(key, source, size) with ``at``, the words of the source before the row, in an order of hashed keys.

    Rows are dealt to stretches of about ``rows_each``; a source's order is by stretch, then key, so that no source,
    however large, is sorted in one task.
    """
    n = max(1, docs.count() // rows_each)
    dealt = docs.withColumn("stretch", F.pmod(F.xxhash64("key"), F.lit(n)))
    sums = dealt.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("s"), F.col("stretch").alias("t"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("source", "stretch").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = dealt.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("t")))
    return joined.select("key", "source", "size", (F.col("at") + F.col("base")).alias("at"))


def plan(sizes: list[tuple[str | None, int]], weights, share, most, block: int, seed: int) -> pd.DataFrame:
    """A row per source: size, target, words taken, blocks, slots and the length of the last, cut, slot."""
    names = sorted((s for s, _ in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * any(s is None for s, _ in sizes)
    size = dict(sizes)
    goal = targets([size[s] for s in names], weights, share, most)
    rows = []
    for i, (s, g) in enumerate(zip(names, goal)):
        words, n = min(round(g), int(most * size[s])), -(-size[s] // block)
        full, rest = divmod(words, size[s]) if size[s] else (0, 0)
        slots, cut = full * n, block
        if rest:
            # slots of the last pass until ``rest`` words; only the source's last block may be short
            key = source_key(s, full, seed)
            short = size[s] - (n - 1) * block
            order_of_last = _slot_of(n - 1, n, key)
            k = -(-rest // block)
            if order_of_last < k:
                k = order_of_last + 1 + max(0, -(-(rest - order_of_last * block - short) // block))
            slots += k
            cut = rest - _words(k - 1, order_of_last, block, short)
        rows.append((i, s, size[s], g, words, n, slots, cut))
    return pd.DataFrame(rows, columns=["number", "source", "source_size", "target", "words", "blocks", "slots", "cut"])


def _words(k: int, order_of_last: int, block: int, short: int) -> int:
    """Words of the first k slots of a pass."""
    return k * block - (block - short) * (k > order_of_last)


def _slot_of(index: int, n: int, key: int, step: int = 1 << 16) -> int:
    """The slot that the permutation maps to a block."""
    for first in range(0, n, step):
        k = np.arange(first, min(n, first + step))
        hit = np.flatnonzero(permute(k, np.full(len(k), n), np.full(len(k), key)) == index)
        if len(hit):
            return first + int(hit[0])
    raise ValueError("not a permutation")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(documents, mixed).

    documents: id, size, source, source_size, target, taken, one row per row. mixed: shard, slot, source, index, pass,
    id, first and last word of each piece of a document in a block, in the order of the shards.

    Null texts and texts of white space have no words and are taken 0 times. Rows with one id count as documents of
    their own. An empty table, or one without words, gives documents with target 0. Reruns and retries agree.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "mixing")
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.select("key", "source", word_count(F.col("_text")).alias("size"))
    rows = tables.save(rows, "sizes")
    sizes = [(r.source, r.words) for r in rows.groupBy("source").agg(F.sum("size").alias("words")).toLocalIterator()]
    p = plan(sizes, weights, share, most, block, seed)
    rows = tables.save(place_words(rows, tables).withColumn("row", F.monotonically_increasing_id()), "placed")

    # Arrow tables become rows without Python workers; those of an RDD would be others than the UDF's, and stay beside them
    counts = shard_counts(p.slots.to_numpy(), shard_slots, seed)
    draws = tables.save_parts((spark.createDataFrame(t) for t in draw_tables(counts, len(p))), "draws")
    about = [(int(r.number), r.source, int(r.source_size), float(r.target), int(r.blocks), int(r.slots), int(r.cut)) for r in p.itertuples()]
    about = spark.createDataFrame(pa.Table.from_pylist([dict(zip(ABOUT.names, r)) for r in about], ABOUT))
    keys = {int(r.number): [source_key(r.source, e, seed) for e in range(int(most) + 1)] for r in p.itertuples()}

    @F.pandas_udf("long")
    def block_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        table = np.array([keys[i] for i in range(len(keys))], np.int64).reshape(len(keys), -1)
        for number, k, n in batches:
            number, k, n = number.to_numpy(), k.to_numpy(), n.to_numpy()
            yield pd.Series(permute(k % n, n, table[number, k // n]))

    # else Spark evaluates it once more, in a second worker of each task, for the filter that it derives from the join
    block_of = block_of.asNondeterministic()
    slots = draws.join(about.select("number", "blocks", "slots", "cut"), "number")
    # a row opens into up to shard_slots slots: a count of its own, which Spark does not merge
    slots = slots.repartition(tasks_for(spark, draws.count()), "shard", "number")
    slots = slots.withColumn("k", F.explode(F.expr("sequence(k, k + n - 1)")))
    slots = slots.withColumn("index", block_of("number", "k", "blocks")).select(
        "shard", "number", "k", "index", (F.col("k") / F.col("blocks")).cast("int").alias("pass"),
        F.when(F.col("k") == F.col("slots") - 1, F.col("cut")).otherwise(F.lit(block)).alias("words"),
    )
    known = about.select("number", F.col("source").alias("s"))
    pieces = rows.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("s")))
    pieces = pieces.select("number", "source", "row", "key", "at", "size", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("index"))
    # words of the piece within its block
    pieces = pieces.withColumn("from", F.greatest(F.lit(0), F.col("at") - F.col("index") * block)).withColumn(
        "to", F.least(F.lit(block), F.col("at") + F.col("size") - F.col("index") * block)
    )
    # Spark takes both sides for as small as they are before explode, and would send all slots through the driver
    mixed = pieces.join(slots.hint("merge"), ["number", "index"]).withColumn("to", F.least("to", "words")).where("to > from")
    taken = mixed.groupBy("row").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    facts = about.select(F.col("source").alias("s"), "source_size", "target")
    documents = (
        rows.join(taken, "row", "left")
        .join(facts, F.col("source").eqNullSafe(F.col("s")), "left")
        .select(F.col("key").alias(id_col), "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )
    mixed = mixed.select(
        "shard", F.col("k").alias("slot"), "source", "index", "pass", F.col("key").alias(id_col),
        (F.col("index") * block + F.col("from") - F.col("at")).alias("first_word"),
        (F.col("index") * block + F.col("to") - F.col("at")).alias("last_word"),
    )
    return documents, mixed
