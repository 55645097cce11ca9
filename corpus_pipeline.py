"""The corpus pipeline: language identification, near duplicates, decontamination, personal data, mixture.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. Nulls, empty texts, repeated rows, empty tables and extra columns are treated as
the operators' docstrings say; extra columns of documents are kept by every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridclime.llm import decontaminate, jaccard_join, language, mixing, pii
from gridclime.llm.queries import PII_KEY, table
from gridclime.llm.store import Tables

#: Posterior below which a document is in no learned language for certain.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter, or without a language above LEAST_SCORE, go."""
    model = language.train(docs)
    columns = [F.col(c) for c in docs.columns]
    row = docs.select(F.struct(*columns).alias("row"), F.col("text"))
    kept = language.identify(row, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select("row.*")


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of what a stage decides on; rows that agree in it are equal to every operator."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64("doc_id", "text", "source", F.concat_ws(",", *[F.col(c).isNull().cast("string") for c in ("doc_id", "text", "source")]))), name


def without(docs: DataFrame, key: str, gone: DataFrame, tables: Tables) -> DataFrame:
    """The rows whose key is not in ``gone``, which is written first, so that Spark knows how large it is."""
    return docs.join(tables.save(gone.select(key).distinct(), "gone"), key, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links stays: that with the smallest id (a null id comes last); of equal rows one.

    Rows are told apart by id, text and source, so other texts of a repeated id are judged for themselves. Rows
    without words are linked with nothing and stay.
    """
    tables = Tables(spark, "near-duplicates")
    rows, key = keyed(docs)
    found = jaccard_join.jaccard_components(rows.select(key, "text"), id_col=key).where("n_shingles > 0")
    counts = tables.save(found.groupBy(key, "component_id").agg(F.count("*").alias("copies")), "components")
    ids = counts.join(rows.select(key, "doc_id").distinct(), key)
    first = F.min_by(key, F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias(key)
    stay = tables.save(ids.groupBy("component_id").agg(first), "stay")
    kept = without(rows, key, counts.join(stay, key, "left_anti"), tables)
    again = tables.save(counts.where("copies > 1").join(stay, key, "left_semi").select(key), "again")
    if not again.head(1):
        return kept.select(docs.columns)
    single = kept.join(again, key, "left_anti")
    return single.unionByName(kept.join(again, key, "left_semi").dropDuplicates([key])).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item; other texts of a repeated id stay."""
    rows, key = keyed(docs)
    found = decontaminate.contaminated(rows.select(key, "text"), table(spark, sf_dir, "benchmark"), id_col=key)
    return without(rows, key, found, Tables(spark, "decontamination")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data and n_chars of the new text."""
    new = pii.replace_pii(docs, PII_KEY)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.size("pii_types") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words: their columns with size, source_size, target and taken.

    A row stands for its document whole, however many of its words the mix takes and how often: the blocks themselves,
    as ranges of words by shard and slot, are the second table of ``mixing.mix`` and would not be documents. Equal rows
    are given the takings of their equals one each, in any order.
    """
    tables = Tables(spark, "mixture")
    rows, key = keyed(docs)
    documents, _ = mixing.mix(rows, id_col=key)
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    figures = [key, "size", "source_size", "target", "taken"]
    taken = tables.save(documents.select(figures), "taken")
    again = tables.save(taken.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "again")
    rows = rows.select(key, *names)
    # a row of figures for each document, which Spark takes for as small as its file: too much for the driver
    once = rows.join(again, key, "left_anti").join(taken.join(again, key, "left_anti").hint("merge"), key)
    if again.head(1):
        number = F.row_number().over(Window.partitionBy(key).orderBy(key)).alias("row_number_")
        many = rows.join(again, key, "left_semi").select("*", number)
        dealt = taken.join(again, key, "left_semi").select("*", number)
        once = once.unionByName(many.join(dealt.hint("merge"), [key, "row_number_"]).drop("row_number_"))
    return once.where("taken > 0").select(*names, *figures[1:])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    tables = Tables(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.save(stage(spark, docs, sf_dir), name)
    return docs
