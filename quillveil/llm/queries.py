"""The queries of the training-data operators, by name. Each takes a session and a data directory."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession

from quillveil.llm import encode, langid, mojibake, packing, pii, readability, replies, sentences
from quillveil.runtime import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_sizes"))


def p8_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.bins_report(p8_containers(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every packing: all documents once, no bin above its capacity."""
    return p8_bins(spark, sf_dir).select("container", "n_documents", "over_full")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.p9_found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.p6_found(table(spark, sf_dir, "sample_data"))


def p6_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.p6_new_text(table(spark, sf_dir, "sample_data"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.p3_found(table(spark, sf_dir, "sample_data"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.p5_found(table(spark, sf_dir, "sample_data"), table(spark, sf_dir, "lang_samples"))


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.p5_languages(table(spark, sf_dir, "sample_data"), table(spark, sf_dir, "lang_samples"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.p4_found(table(spark, sf_dir, "sample_data"))


def pseudonym_key(spark: SparkSession) -> bytes:
    """The key of pseudonyms that the session gives in ``quillveil.pseudonym.key``; without one a new one that nobody keeps."""
    given = spark.conf.get("quillveil.pseudonym.key", None)
    return given.encode() if given else secrets.token_bytes(32)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.p2_found(table(spark, sf_dir, "sample_data"), table(spark, sf_dir, "gazetteer"))


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.p2_masked(table(spark, sf_dir, "sample_data"), table(spark, sf_dir, "gazetteer"), pseudonym_key(spark))


QUERIES = {
    "p2_found": p2_found,
    "p2_masked": p2_masked,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_languages": p5_languages,
    "p6_found": p6_found,
    "p6_new_text": p6_new_text,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_bins": p8_bins,
    "p8_whole": p8_whole,
    "p9_found": p9_found,
}
#: SQL of what can be said without the models.
SQL: dict[str, str] = {
    "p8_whole": "SELECT container, (SELECT count(*) FROM documents) AS n_documents, CAST(0 AS BIGINT) AS over_full FROM container_sizes",
}
