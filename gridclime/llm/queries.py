"""Registered queries of the operators, each over its whole table, with SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    clustering, decontaminate, filter_audit, fingerprint, jaccard_join, language, license_scan, mixing, pii, quality,
    secret_scan, url_filter, warc,
)

PII_KEY = "a key for tests; production keys are secret"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_of(parts: int):
    """crc32 of the id's text modulo parts."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "dice", F.size("licenses").alias("n_matches"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(part_of(5) != 0))
    scored = quality.classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (part_of(5) == 0).alias("held_out"), "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(part_of(4) != 2))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (part_of(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "strict_terms", "soft_terms", "rule", "verdict")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return new.select("doc_id", "text", F.size("pii_types").cast("long").alias("n_entities"), "pii_types")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select(
        F.col("id").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = clustering.cluster(table(spark, sf_dir, "embeddings"))
    return found


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    of = lambda kind: F.filter("spans", lambda s: s.kind == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.KINDS[:3]]
    base = F.sha2(text(F.filter("spans", lambda s: s.kind != secret_scan.KINDS[3])), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_decontamination, op3_license_scan, op4_quality, op5_language_id, op6_url_filter,
        op7_pii_surrogates, op8_jaccard_join, op9_mixture, op10_warc, op11_clusters,
        op12_secret_scan, op13_filter_audit,
    )
}
SQL = {"op6_url_filter": url_filter.oracle(), "op13_filter_audit": filter_audit.oracle()}
