"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Tables
from .tokens import MIXED, Tokens, chunks, mix, tokenise

DIMENSIONS = 1 << 17
#: Labelled rows that the model is fitted on, about; they are taken by a hash of their id.
FIT_ROWS = 20_000
SHARDS, ROUNDS = 8, 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
SCALE = 20.0


def _grams(codes: np.ndarray, tokens: Tokens, width: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """(token position, feature) of the n-grams that stay in their document."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, np.uint64(family), np.uint64)
    for k in range(width):
        h = mix(h + codes[k : k + n])
    at = np.arange(n)
    document = np.searchsorted(tokens.bounds, at, "right") - 1
    inside = at + width <= tokens.bounds[document + 1]
    return at[inside], (h[inside] & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def features(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each n-gram: of one to two words, and of one to three word forms.

    A form tells letters, digits or signs, capitals at the ends, one-letter words, and whether the word repeats the one
    before it. Signs are words of their own.
    """
    if not len(tokens.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = tokens.data[tokens.starts], tokens.data[tokens.ends - 1]
    capital = lambda b: ((b >= 65) & (b <= 90)).astype(np.uint64)
    form = tokens.kinds.astype(np.uint64) + np.uint64(4) * capital(first) + np.uint64(8) * capital(last)
    form += np.uint64(16) * (tokens.ends - tokens.starts == 1)
    form[1:] += np.uint64(32) * (tokens.hashes[1:] == tokens.hashes[:-1])
    signs = tokens.kinds == 3
    form[signs] += tokens.hashes[signs] & ~np.uint64(63)
    parts = [_grams(tokens.hashes, tokens, w, w) for w in (1, 2)] + [_grams(form, tokens, w, 10 + w) for w in (1, 2, 3)]
    at, feature = (np.concatenate(p) for p in zip(*parts))
    return np.searchsorted(tokens.bounds, at, "right") - 1, feature


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the regularised leader for sums z of adjusted gradients and n of squared gradients."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(rows: list[tuple[float, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of updates over rows (label, features, values); the last place of z and n is the bias."""
    for y, at, x in rows:
        w = weights(z[at], n[at])
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - step * w
        n[at] += g * g


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    fit_rows: int = FIT_ROWS, rounds: int = ROUNDS,
) -> np.ndarray:
    """Weights, the bias last. docs and labels meet by id; rows without a text or label are left out.

    Each round, shards of the rows start from the common state and update it one row after another; the states are
    averaged by Spark. The result does not depend on how the rows are partitioned.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "quality")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("y is not null")
    share = fit_rows / max(1, known.count())
    known = known.where((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)) < share).dropDuplicates(["id"])
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # known is bounded by fit_rows
    given = given.join(F.broadcast(known), "id").select("id", "y", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = [], []
            for _, _, data, offsets in chunks(b.column(2)):
                t = tokenise(data, offsets, MIXED)
                doc, feature = features(t)
                order = np.argsort(doc, kind="stable")
                feature = feature[order]
                bounds = np.searchsorted(doc[order], np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    u, c = np.unique(feature[bounds[i] : bounds[i + 1]], return_counts=True)
                    tokens = max(1, int(t.bounds[i + 1] - t.bounds[i]))
                    at.append(np.append(u, DIMENSIONS).tobytes())
                    x.append(np.append(c * (SCALE / tokens), 1.0).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["id", "y", "at", "x"]
            )

    rows = given.mapInArrow(sparse, "id long, y double, at binary, x binary")
    rows = tables.save(rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SHARDS))), "rows")
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    shards = max(1, rows.select("shard").distinct().count())
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))

        def update(table: pa.Table) -> pa.Table:
            z, n = (v.copy() for v in state.value)
            columns = (table.column(c).to_pylist() for c in ("id", "y", "at", "x"))
            own = sorted(zip(*columns), key=lambda r: ((r[0] * 0x9E3779B9) & 0xFFFFFFFF, r[0]))
            learn([(y, np.frombuffer(a, np.int64), np.frombuffer(x)) for _, y, a, x in own], z, n)
            at = np.flatnonzero(n)
            return pa.table({"at": at, "z": z[at], "n": n[at]})

        found = rows.groupBy("shard").applyInArrow(update, "at long, z double, n double").groupBy("at").agg(
            F.sum("z").alias("z"), F.sum("n").alias("n"), F.count("*").alias("k")
        ).toPandas()
        # shards that have not met a feature keep its state
        k = found.k.to_numpy()
        at = found["at"].to_numpy()
        z[at] = (found.z.to_numpy() + (shards - k) * z[at]) / shards
        n[at] = (found.n.to_numpy() + (shards - k) * n[at]) / shards
        state.unpersist()
    return weights(z, n)


def score(text: Column, w: np.ndarray) -> Column:
    """Probability of label 1 for each text; empty and null texts have the bias alone."""
    given = SparkSession.active().sparkContext.broadcast(w)

    @F.arrow_udf("double")
    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = given.value
        for column in batches:
            out = np.full(len(column), w[-1])
            for first, last, data, offsets in chunks(column):
                t = tokenise(data, offsets, MIXED)
                doc, feature = features(t)
                if len(doc):
                    sums = np.bincount(doc, w[feature], last - first)
                    out[first:last] += sums * SCALE / np.maximum(1, np.diff(t.bounds))
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return one(text)


def classify(docs: DataFrame, w: np.ndarray, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """Adds score and predicted (1 if score >= least); columns of these names are replaced, rows kept as they are."""
    out = docs.withColumn("score", score(F.col(text_col).cast("string"), w))
    return out.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))
