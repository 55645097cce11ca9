"""Document fingerprints: Merkle trees of paragraphs and sections, with DataFrame functions only.

A paragraph is a line; its branches are pieces that end with a sentence or after 24 code points at the latest, at a
space if there is one. A section ends before a heading or blank line, or after a paragraph whose hash says so, so that
an edit moves no border elsewhere. Section hashes make the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A section ends after a paragraph whose hash starts with a character whose code this divides: two of sixteen.
SECTION = 8
PIECE = r"(?s).{1,24}?(?:[.!?;|]+\s+|\z)|.{1,24}(?:\s+|\z)|.{24}"


def with_tree(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds struct(root, sections, paragraphs, pieces) of a text; null is empty. pieces are 64-bit hashes, the others SHA-256.

    Each level is a column of its own, as the functions inside an array function are evaluated once for each element.
    """
    lines, paragraphs, starts, sections, pieces = (F.col(f"_{k}") for k in ("lines", "paragraphs", "starts", "sections", "pieces"))
    df = df.withColumn("_lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    df = df.withColumn("_paragraphs", F.transform(lines, lambda p: F.sha2(p, 256)))
    # a section starts at the first paragraph, a heading, after a blank line, or after a paragraph with a chosen hash
    df = df.withColumn(
        "_starts",
        F.filter(
            F.sequence(F.lit(0), F.size(lines) - 1),
            lambda i: (i == 0)
            | F.get(lines, i).startswith("#")
            | (F.trim(F.get(lines, i - 1)) == "")
            | (F.ascii(F.get(paragraphs, i - 1)) % SECTION == 0),
        ),
    )
    df = df.withColumn(
        "_sections",
        F.transform(
            starts,
            lambda a, k: F.sha2(F.array_join(F.slice(paragraphs, a + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - a), ""), 256),
        ),
    )
    df = df.withColumn(
        "_pieces",
        F.array_distinct(F.flatten(F.transform(lines, lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x))))),
    )
    root = F.sha2(F.array_join(sections, ""), 256)
    made = F.struct(root.alias("root"), sections.alias("sections"), paragraphs.alias("paragraphs"), pieces.alias("pieces"))
    return df.withColumn(name, made).drop("_lines", "_paragraphs", "_starts", "_sections", "_pieces")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the Dice coefficient of the two trees' distinct pieces, below 1; 0 if either has none."""
    both = F.size(a["pieces"]) + F.size(b["pieces"])
    dice = F.when(both > 0, 2 * F.size(F.array_intersect(a["pieces"], b["pieces"])) / both).otherwise(0.0)
    return F.when(a["root"] == b["root"], 1.0).otherwise(F.least(dice, F.lit(0.999999)))


def first_change(a: Column, b: Column, level: str) -> Column:
    """Number of the first section or paragraph in which two trees differ; null for equal roots."""
    n = F.greatest(F.size(a[level]), F.size(b[level]))
    places = F.sequence(F.lit(0), n - 1)
    at = F.filter(places, lambda i: ~F.get(a[level], i).eqNullSafe(F.get(b[level], i)))
    return F.when(a["root"] != b["root"], F.get(at, F.lit(0)))


def _stretches(docs: DataFrame, n: int) -> list[int]:
    """Ids that cut the documents into about n stretches of equal counts."""
    if n < 2:
        return []
    cuts = docs.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"]
    return sorted(set(cuts or []))


def _stretch_of(id_: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below an id, by halving."""
    if not cuts:
        return F.lit(0)
    table = F.array(*map(F.lit, cuts))
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, s: F.when((at + s <= len(cuts)) & (F.get(table, at + s - 1) <= id_), at + s).otherwise(at),
    )


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; one row per row of docs.

    The edited text has its last half replaced by the start of the next document's by ascending id, after the last
    the first's. Null texts count as empty, null ids come first, and rows with one id follow each other by text.
    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, first_section,
    first_paragraph (of the first difference to the edited text).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _stretches(rows, 4 * n)
    ends = rows.agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id")).alias("m")).first()["m"]
    least = ends["id"] if ends else None
    stretch = F.when(F.col("id").isNull(), 0).otherwise(_stretch_of(F.col("id"), cuts))
    # the first rows of a stretch also end the one before it, the first of all the last one
    border = F.col("id").isin(cuts) if cuts else F.lit(False)
    homes = F.concat(
        F.array(F.struct(stretch.alias("at"), F.lit(0).alias("guest"))),
        F.when(border, F.array(F.struct((stretch - 1).alias("at"), F.lit(1).alias("guest")))).otherwise(F.array().cast("array<struct<at:int,guest:int>>")),
        F.when(F.col("id").eqNullSafe(F.lit(least)), F.array(F.struct(F.lit(len(cuts)).alias("at"), F.lit(2).alias("guest")))).otherwise(
            F.array().cast("array<struct<at:int,guest:int>>")
        ),
    )
    rows = rows.withColumn("home", F.explode(homes)).select("id", "text", "home.at", "home.guest")
    order = Window.partitionBy("at").orderBy("guest", F.col("id").asc_nulls_first(), "text")
    # one exchange of texts; trees are made after it and meet within the same stretches
    rows = with_tree(rows.withColumn("next", F.lead("text").over(order)), "text", "tree")
    rows = rows.withColumn("next_tree", F.lead(F.struct("tree.root", "tree.pieces")).over(order)).where("guest = 0")
    n_chars = F.length("text")
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next, int(length(text) div 2))")))
    rows = with_tree(rows, "edited", "edited_tree")
    return rows.select(
        F.col("id").alias(id_col),
        n_chars.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("tree.root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        first_change(F.col("tree"), F.col("edited_tree"), "sections").alias("first_section"),
        first_change(F.col("tree"), F.col("edited_tree"), "paragraphs").alias("first_paragraph"),
    )
