"""Language identification by unigram pieces, summed over all segmentations of each word."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Tables
from .tokens import WORDS, chunks, mix, tokenise

#: Public piece vocabulary.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of the longest piece that is used, and of the stretches that longer words are cut into.
PIECE_BYTES, WORD_BYTES = 12, 24
#: Documents of a language that the model is fitted on, about.
FIT_DOCS = 1000


class Pieces:
    """Trie of the vocabulary: next[node, byte], nodes with children first; node 0 is the root and means no child."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = []
        for p in sorted(set(pieces)):
            node = 0
            for byte in p:
                if byte not in children[node]:
                    children.append({})
                    children[node][byte] = len(children) - 1
                node = children[node][byte]
            ends.append(node)
        inner = [i for i, c in enumerate(children) if c]
        order = inner + [i for i, c in enumerate(children) if not c]
        number = np.empty(len(children), np.int32)
        number[order] = np.arange(len(children))
        self.inner = len(inner)
        self.next = np.zeros((len(inner), 256), np.int32)
        for i in inner:
            for byte, child in children[i].items():
                self.next[number[i], byte] = number[child]
        self.nodes = len(children)
        self.ends = np.sort(number[ends])

    @classmethod
    def load(cls, path: str, longest: int = PIECE_BYTES) -> "Pieces":
        """Pieces of a public vocabulary file, the start of a word as a space, and each single byte."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        own = (p.replace("▁", " ").encode() for p in own)
        return cls([p for p in own if 0 < len(p) <= longest] + [bytes([b]) for b in range(256)])


def paths(pieces: Pieces, chars: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, words, nodes) of every piece in the words, by place. chars: words by row, longest first."""
    width = chars.shape[1]
    alive = np.searchsorted(-lengths, -np.arange(width), "left")  # words longer than each place
    for i in range(width):
        words = np.arange(alive[i])
        node = np.zeros(len(words), np.int32)
        for j in range(i, min(width, i + PIECE_BYTES)):
            if j > i:
                keep = (node < pieces.inner) & (words < alive[j])
                words, node = words[keep], node[keep]
            if not len(words):
                break
            node = pieces.next[node, chars[words, j]]
            keep = node > 0
            words, node = words[keep], node[keep]
            yield i, j + 1, words, node


def rows_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, chars, lengths): the words with a space before them as rows of bytes, longest first."""
    n = ends - starts
    order = np.argsort(-n, kind="stable")
    starts, n = starts[order], n[order]
    width = int(n[0]) if len(n) else 0
    chars = np.full((len(n), width + 1), 32, np.uint8)
    at = np.arange(width)
    inside = at < n[:, None]
    chars[:, 1:][inside] = data[(starts[:, None] + at)[inside]]
    return order, chars, n + 1


def log_sums(pieces: Pieces, prob: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language: forward sums over all segmentations. prob: node x language."""
    forward = np.zeros((chars.shape[1] + 1, len(lengths), prob.shape[1]))
    forward[0] = 1
    for i, j, words, node in paths(pieces, chars, lengths):
        forward[j, words] += forward[i, words] * prob[node]
    return np.log(forward[lengths, np.arange(len(lengths))])


def expected(pieces: Pieces, prob: np.ndarray, chars: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each node in one language, by forward and backward sums."""
    steps = list(paths(pieces, chars, lengths))
    forward, backward = (np.zeros((chars.shape[1] + 1, len(lengths))) for _ in range(2))
    forward[0] = 1
    for i, j, words, node in steps:
        forward[j, words] += forward[i, words] * prob[node]
    all_ = np.arange(len(lengths))
    backward[lengths, all_] = 1
    out = np.zeros(pieces.nodes)
    share = counts / forward[lengths, all_]
    for i, j, words, node in reversed(steps):
        p = prob[node] * backward[j, words]
        backward[i, words] += p
        out += np.bincount(node, forward[i, words] * p * share[words], pieces.nodes)
    return out


def cut_words(starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of more than WORD_BYTES bytes as several; with the number of the word that each comes from."""
    n = -(-(ends - starts) // WORD_BYTES)
    word = np.repeat(np.arange(len(starts)), n)
    part = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    first = starts[word] + part * WORD_BYTES
    return first, np.minimum(first + WORD_BYTES, ends[word]), mix(hashes[word] + part.astype(np.uint64)), word


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", path: str = VOCABULARY, fit_docs: int = FIT_DOCS,
    rounds: int = 3, smoothing: float = 0.05,
) -> tuple[Pieces, list[str], np.ndarray]:
    """(pieces, languages, prob[node, language]) fitted by expectation maximisation on about fit_docs texts a language.

    The texts are taken by a hash of the text. Rows with a null language or text are left out.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "language")
    pieces = Pieces.load(path)
    rows = docs.select(F.lower(F.col(text_col).cast("string")).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    languages = sorted(sizes)
    if not languages:
        return pieces, [], np.zeros((pieces.nodes, 0))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(fit_docs / n)).otherwise(share)
    rows = rows.where((F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)) < share)
    words = rows.select("lang", F.explode(F.split("text", "[\\x20\\x09-\\x0D]+")).alias("word")).where("word <> ''")
    words = words.select("lang", F.explode(F.expr(f"transform(sequence(1, length(word), {WORD_BYTES // 2}), i -> substr(word, i, {WORD_BYTES // 2}))")).alias("word"))
    words = tables.save(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    prob = np.zeros((pieces.nodes, len(languages)))
    prob[pieces.ends] = 1 / len(pieces.ends)
    for _ in range(rounds):
        given = spark.sparkContext.broadcast((vars(pieces), prob))

        def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fields, prob = given.value
            pieces = SimpleNamespace(**fields)
            total = np.zeros_like(prob)
            for b in batches:
                lang, n = np.array(b.column(0).to_pylist(), object), b.column(2).to_numpy()
                words = [w.encode() for w in b.column(1).to_pylist()]
                data = np.frombuffer(b"".join(words), np.uint8)
                ends = np.cumsum([len(w) for w in words])
                starts = np.concatenate([[0], ends[:-1]]) if len(words) else ends
                for k, name in enumerate(languages):
                    own = np.flatnonzero(lang == name)
                    if len(own):
                        order, chars, lengths = rows_of(data, starts[own], ends[own])
                        total[:, k] += expected(pieces, prob[:, k], chars, lengths, n[own][order].astype(float))
            node, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(k), pa.array(total[node, k])], ["node", "k", "uses"])

        found = words.mapInArrow(uses, "node long, k long, uses double").groupBy("node", "k").agg(F.sum("uses").alias("uses")).toPandas()
        total = np.zeros_like(prob)
        total[pieces.ends] = smoothing
        total[found.node, found.k] += found.uses
        prob = total / total.sum(axis=0)
        given.unpersist()
    return pieces, languages, prob


def scores(text: Column, model: tuple[Pieces, list[str], np.ndarray]) -> Column:
    """Array of the log probability of a lower-cased text in each language."""
    pieces, languages, prob = model
    given = SparkSession.active().sparkContext.broadcast((vars(pieces), prob))

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fields, prob = given.value
        pieces = SimpleNamespace(**fields)
        for column in batches:
            out = np.zeros((len(column), prob.shape[1]))
            for first, last, data, offsets in chunks(column):
                t = tokenise(data, offsets, WORDS)
                if not len(t.hashes):
                    continue
                starts, ends, hashes, word = cut_words(t.starts, t.ends, t.hashes)
                _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                value = np.empty((len(at), prob.shape[1]))
                by_length = np.argsort(starts[at] - ends[at], kind="stable")
                for a in range(0, len(at), 20_000):
                    part = by_length[a : a + 20_000]
                    order, chars, lengths = rows_of(data, starts[at[part]], ends[at[part]])
                    value[part[order]] = log_sums(pieces, prob, chars, lengths)
                doc = np.searchsorted(t.bounds, word, "right") - 1
                for k in range(prob.shape[1]):
                    out[first:last, k] += np.bincount(doc, value[inverse, k], last - first)
            yield pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32) if out.shape[1] else np.zeros(len(column) + 1, np.int32), out.ravel())

    return score(text)


def identify(docs: DataFrame, model: tuple[Pieces, list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """Adds lang_pred (und for null texts and texts without a letter, or if no language was learned) and score.

    The score is the posterior of the language under equal priors, 0 for und. Columns of these names are replaced;
    rows are kept as they are, repeated ones too. Words of more than WORD_BYTES bytes are scored in stretches.
    """
    languages = model[1]
    text = F.col(text_col).cast("string")
    if not languages:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    out = docs.withColumn("_s", scores(F.lower(text), model))
    best = F.array_max("_s")
    sure = 1 / F.aggregate("_s", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    known = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    pred = F.element_at(F.array(*map(F.lit, languages)), F.array_position("_s", best).cast("int"))
    return out.withColumns(
        {"lang_pred": F.when(known, pred).otherwise("und"), "score": F.when(known, sure).otherwise(0.0)}
    ).drop("_s")
