"""Queries of the corpus operators and of the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, decontam, katz, kdtree, nearjoin, pieces, pii, quality, repair, secrets, substring, warc, whiten
from .common import table


def op1_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), kdtree.quantize(F.col("embedding")).alias("v"))
    return kdtree.top_k(vectors, F.col("id") % 50 == 0)


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("span_list")


def op5_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.write(table(spark, sf_dir, "documents")))


def op6_forest_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.classes(table(spark, sf_dir, "documents"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_report(table(spark, sf_dir, "pages"))


def op9_countmin_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op10_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.decode(encoded).select(
        "doc_id", "n_pieces", "ids_crc32", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    )


def op11_covariance_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op12_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents")).drop("span_list")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kdtree_top_k": op1_kdtree_top_k,
        "op2_katz_scores": op2_katz_scores,
        "op3_template_decontamination": op3_template_decontamination,
        "op4_bootstrapped_pii": op4_bootstrapped_pii,
        "op5_repair_token_ids": op5_repair_token_ids,
        "op6_forest_jaccard": op6_forest_jaccard,
        "op7_ordinal_quality": op7_ordinal_quality,
        "op8_revisit_resolution": op8_revisit_resolution,
        "op9_countmin_substring": op9_countmin_substring,
        "op10_unigram_pieces": op10_unigram_pieces,
        "op11_covariance_whitening": op11_covariance_whitening,
        "op12_randomness_secrets": op12_randomness_secrets,
        "op13_phrase_collocations": op13_phrase_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_kdtree_top_k": kdtree.ORACLE, "op8_revisit_resolution": warc.ORACLE, "op13_phrase_collocations": collocations.ORACLE}
