"""Queries of the training-data operators with their production parameters, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import centroids, codes, embeddings, html, jaccard, langid, licences, mixing, packing, quality, suffixes, toxicity
from siftwork.session import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), langid.fit(table(spark, sf_dir, "documents")))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs.select("doc_id", licences.directory_of_documents().alias("directory"), "text"))


def op7_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.top_k(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_licence_scan": op6_licence_scan,
    "op7_mixing_to_target_weights": op7_mixing_to_target_weights,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_packing": op9_packing,
    "op10_html_extraction": op10_html_extraction,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_quality_rules": op12_quality_rules,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op2_suffix_array_dedup": suffixes.ORACLE,
    "op4_embedding_near_dedup": embeddings.ORACLE_LINKS,
    "op5_ngram_jaccard_join": jaccard.ORACLE,
    "op6_licence_scan": licences.oracle(),
    "op7_mixing_to_target_weights": mixing.ORACLE,
    "op8_exact_top_k": embeddings.ORACLE_SEARCH,
    "op11_centroid_clustering": centroids.ORACLE,
    "op12_quality_rules": quality.ORACLE,
    "op13_vector_codes": codes.ORACLE,
}
