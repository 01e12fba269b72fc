"""The registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame`` and SQL.

Each reads its whole tables and returns its operator's full result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import centroids, chat, decontam, langid, license_scan, mixing, ngram_join, pii, quality, rules, topk, trie, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a fifth of them is held out from learning."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template blocks of every document."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents (5 words, Jaccard 0.75)."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a third of the labels is held out."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    return pii.find(_table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best neighbours of every vector whose id is divisible by 50."""
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replicated so that every source weighs the same, shuffled."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in reply order, without quotations."""
    return chat.reply_order(_table(spark, sf_dir, "conversations"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it holds."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages into WARC archives and reads them back; a record that fails a
    verification ends the query."""
    records = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))
    checked = F.when(F.col("error").isNull(), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("WARC record: "), F.col("error"))))
    return records.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and learned quality rules over every document."""
    return rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds of 40 centroids over all vectors."""
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over documents."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_license_scan, op3_ngram_jaccard_join, op4_quality_classifier, op5_pii, op6_exact_topk, op7_mixing,
    op8_chat_formatting, op9_decontamination, op10_warc, op11_prefix_trie, op12_quality_rules, op13_centroid_clustering, pipeline)}

#: DuckDB SQL of the queries that SQL can express; the others are tested by brute force.
ORACLES: dict[str, str] = {"op6_exact_topk": topk.SQL, "op7_mixing": mixing.SQL, "op10_warc": warc.SQL,
                           "op11_prefix_trie": trie.SQL, "op13_centroid_clustering": centroids.SQL}
