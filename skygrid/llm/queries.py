"""Queries of the training-data operators: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrid.llm import attention_lm, decontaminate, html_extract, manifest, mixing, neighbours, ngram_join, oracles, quality, resample, secret_scan, sharding, substring_dedup, suffix_dedup

#: Target weights by level; names that are not listed weigh 1.
WEIGHTS = {"domain": {"a": 3, "b": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}

#: Share of all tokens that the mixture takes, and epochs at most; shards.
MIXED, EPOCHS, SHARDS = 0.7, 2, 40


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_read(spark, sf_dir, "documents")).drop("kept_text")


def op2_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(_read(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    scored = quality.classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents"), WEIGHTS, budget=MIXED, epochs=EPOCHS)
    return out.select("doc_id", "domain", "lang", "source", "epoch")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_read(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), SHARDS)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_attention_lm, op3_benchmark_decontamination, op4_projected_neighbours, op5_quality_ranking, op6_mixture, op7_suffix_dedup, op8_html_extraction, op9_kd_sharding, op10_ngram_jaccard_join, op11_importance_resampling, op12_secret_scan, op13_merkle_manifest, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": oracles.substring_dedup(),
        "op6_mixture": oracles.mixture(WEIGHTS, MIXED, EPOCHS),
        "op7_suffix_dedup": oracles.suffix_dedup(),
        "op9_kd_sharding": oracles.kd_shards(SHARDS),
        "op10_ngram_jaccard_join": oracles.jaccard_components(),
        "op11_importance_resampling": oracles.importance_resampling(),
        "op12_secret_scan": oracles.secret_scan_spans(),
        "op13_merkle_manifest": oracles.merkle_manifest(),
    }
