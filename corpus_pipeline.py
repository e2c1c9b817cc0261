"""Corpus pipeline: quality, near duplicates, decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever their names. Rows that repeat a
doc_id are rows of their own, but for near duplicates; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrid.llm import decontaminate, mixing, ngram_join, quality, sharding
from skygrid.llm.common import by_key, table, text_hash
from skygrid.llm.queries import WEIGHTS

#: Share of the remaining tokens that the mixture keeps.
BUDGET = 0.9


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects, null and empty texts among them if it does. Texts are read whole, however long; equal ones fare alike."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.classify(docs, model, ("_score", "_predicted"))
    return scored.where("_predicted = 1").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group linked by five-word shingles at 0.8 the document with the smallest (doc_id, hash of the text), once.

    Documents without words are in no group and stay, repeated or not.
    """
    found = table(ngram_join.labelled(docs, k=5, num=4, den=5).where("component is not null"))
    # a component may hold a third of all rows: its key is broadcast as far as the table of components allows
    lead = table(found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("lead")).where("n > 1"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    of_groups = by_key(found, lead, "component")
    key = lambda rows: table(rows.select(F.col("doc_id").alias("_d"), F.col("th").alias("_th")).distinct())
    gone = key(of_groups.where(~first.eqNullSafe(F.col("lead"))))
    again = key(of_groups.where(first.eqNullSafe(F.col("lead"))).groupBy("doc_id", "th").count().where("count > 1"))
    at = lambda d: d["doc_id"].cast("long").eqNullSafe(F.col("_d")) & (text_hash(d["text"]) == F.col("_th"))
    kept = by_key(docs, gone, at(docs), "left_anti")
    if not again.limit(1).count():
        return kept
    once = by_key(kept, again, at(kept), "left_semi").withColumn("_th", text_hash(F.col("text"))).dropDuplicates(["doc_id", "_th"]).drop("_th")
    return by_key(kept, again, at(kept), "left_anti").unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage; null and empty texts hold none, and a clean text of a doc_id whose other text holds one stays."""
    found = decontaminate.keyed_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.clean(docs, found)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's share of the token budget; no document twice, those without tokens as far as the prefix reaches.

    A document's length counts in tokens, however long it is; rows that repeat a doc_id share their place and go or stay together.
    """
    return mixing.mix(docs, WEIGHTS, budget=BUDGET, epochs=1, names=("_mixed_domain", "_mixed_epoch")).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assign each document its shard and slot, null and empty texts (size 16) too; no text is split, however long, and ties are told apart by a draw of doc_id and text."""
    return sharding.shard(docs, 40)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixture_stage),
    ("sharding", sharding_stage),
]

#: The classifier's weights and the near-duplicate components are not SQL; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(docs)
    return docs
