"""What each of several quality filters removes, in every order in which they can be applied.

A document's failures form a combination of bits. Repeated texts are marked by an existential self-join: a document fails
where a row of the same hash, the same exact text and a smaller id exists. The ids of these failures are put under those
of the other filters and combined by id; only counts of bit combinations per part (at most 2**filters each) meet the
orders, which are computed from these counts without reading a document again.

Defined cases: a null text is empty, a null part is the empty string; a null id is in no order, so it neither fails as a
copy nor makes another row one, and has no labels; equal rows count as often as they occur and, having no smaller id,
are no copies of each other; several labels of an id: one that says 1 is enough; no documents give no rows. Columns
other than id, text, part and the two labels are not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Tables

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Rows of one text that share a key of the self-join; more are dealt over several keys.
ROWS_A_KEY = 8192
COPY = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def copies(rows: DataFrame, tables: Tables) -> DataFrame:
    """Rows (id, text, hash, ...) to whose text another row with a smaller id is equal, without the text.

    Only texts whose hash repeats take part; the smallest id of each stands for all of its rows, so a text with most of
    the rows is one row on the right side, repeated once for every ROWS_A_KEY rows on the left.
    """
    known = rows.where(F.col("id").isNotNull())
    counts = known.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that Spark knows its size before it chooses the joins with the texts
    repeated = tables.save(counts.select("hash", F.ceil(F.col("n") / ROWS_A_KEY).alias("keys")), "repeated")
    candidates = known.join(repeated, "hash")
    first = candidates.groupBy("hash", "text", "keys").agg(F.min("id").alias("first"))
    first = first.withColumn("key", F.explode(F.sequence(F.lit(1).cast("long"), "keys"))).drop("keys")
    left = candidates.withColumn("key", F.pmod(F.xxhash64("id"), "keys") + 1).drop("keys").alias("l")
    same = (F.col("l.hash") == F.col("r.hash")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.text") == F.col("r.text"))
    return left.join(first.alias("r"), same & (F.col("r.first") < F.col("l.id")), "left_semi").drop("text", "key")


def combinations(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column], id_col: str, text_col: str, part_col: str,
    good_col: str, toxic_col: str,
) -> tuple[DataFrame, str]:
    """(part, mask, n, good, toxic): documents by combination of failures; bit i is the i-th of the letters returned."""
    tables = Tables(docs.sparkSession, "audit")
    letters = "".join([*filters, COPY])
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
    )
    # id, part and two hashes name a row: rows that agree in them are equal and fail alike
    rows = rows.withColumns({"hash": F.xxhash64("text"), "hash2": F.xxhash64(F.lit(1), "text")})
    names = ["id", "part", "hash", "hash2"]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    single = rows.select(*names, mask.alias("mask"), F.lit(1).alias("n"))
    copied = copies(rows, tables).select(*names, F.lit(1 << len(filters)).alias("mask"), F.lit(0).alias("n"))
    failed = single.unionByName(copied).groupBy(*names).agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
    # at most 2**filters rows of an id and part meet its label
    per_id = failed.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    marks = labels.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce((F.col(good_col) == 1).cast("int"), F.lit(0)).alias("good"),
        F.coalesce((F.col(toxic_col) == 1).cast("int"), F.lit(0)).alias("toxic"),
    ).where("id is not null and (good = 1 or toxic = 1)")
    marks = marks.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    marked = per_id.join(marks, "id", "left")
    of = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic")), letters


def orders(counts: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from
    combinations; every part has every step of every order."""
    every = ["".join(p) for p in permutations(letters)]
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = cells.withColumn("filter_order", F.explode(F.split(F.lit(",".join(every)), ",")))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    bit = lambda i: f"shiftleft(1, instr('{letters}', substring(filter_order, {i}, 1)) - 1)"
    steps = steps.withColumns(
        {
            "bit": F.expr(bit("step")),
            "before": F.expr(f"aggregate(sequence(1, {len(letters)}), 0, (m, i) -> if(i < step, m | {bit('i')}, m))"),
        }
    )

    def total(condition: str, value: str = "c.n") -> Column:
        return F.expr(f"aggregate(filter(cells, c -> {condition}), 0L, (s, c) -> s + {value})")

    fails, earlier = "c.mask & bit != 0", "c.mask & before != 0"
    return steps.select(
        "part", "filter_order", "step",
        total("c.mask & (before | bit) = 0").alias("kept"),
        total(f"{fails} and not {earlier}").alias("removed"),
        total(f"{fails} and {earlier}").alias("redundant"),
        total("c.mask = bit").alias("unique_fails"),
        total(f"{fails} and not {earlier}", "c.good").alias("good_lost"),
        total(f"{fails} and not {earlier}", "c.toxic").alias("toxic_lost"),
        # of m failures, each comes first in one of m orders
        total(fails, f"c.n * ({factorial(len(letters))} div bit_count(c.mask))").alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, id_col: str = "doc_id",
    text_col: str = "text", part_col: str = "source", good_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """The report of ``orders`` over all documents. ``filters`` are failure conditions on a column named ``text`` by
    letter, those of ``text_filters`` where none are given; the filter of copies comes last."""
    chosen = text_filters(F.col("text")) if filters is None else filters
    counts, letters = combinations(docs, labels, chosen, id_col, text_col, part_col, good_col, toxic_col)
    return orders(counts, letters)


def oracle() -> str:
    return """
WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents
), words AS (
  SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY body) AS first_id FROM rows
), masks AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
  FROM words
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(l, b)),
perms AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f a, f b, f c, f d, f e
  WHERE a.b | b.b | c.b | d.b | e.b = 31
), steps AS (
  SELECT filter_order, s.step, bits[s.step] AS bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::INTEGER AS before
  FROM perms, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
)
SELECT part, filter_order, step,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & bit <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT AS shapley
FROM counts, steps
GROUP BY part, filter_order, step
"""
