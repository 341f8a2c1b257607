"""The numbered queries: thin callables over the operators, with production parameters, on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import centroids, conversation_repair, fingerprints, html_text, license_scan, media_chunks, ngram_join, packing, quality, token_counts, toxicity, url_filters, word_bpe
from .common import table


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_features(table(spark, sf_dir, "documents"))


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_grouped(table(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scans,
        op2_ngram_jaccard_join,
        op3_toxicity,
        op4_token_counts,
        op5_quality_classifier,
        op6_media_columns,
        op7_bpe_encode_decode,
        op8_best_fit_packing,
        op9_url_filters,
        op10_document_fingerprints,
        op11_html_extraction,
        op12_conversation_repair,
        op13_centroid_clustering,
    )
}
ORACLES: dict[str, str] = {
    "op1_license_scans": license_scan.oracle_sql(),
    "op2_ngram_jaccard_join": ngram_join.oracle_sql(3, 90),
    "op9_url_filters": url_filters.oracle_sql(),
    "op12_conversation_repair": conversation_repair.oracle_sql(),
    "op13_centroid_clustering": centroids.oracle_sql(),
}
