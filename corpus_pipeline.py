"""The training-data pipeline: documents through five operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept.  ``run`` writes every stage's rows as Parquet in the shared folder and
reads them back as the next stage's documents.

Edge cases are those of the operators; a null doc_id stays through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from askbase.llm import decontaminate, mixing, ngram_join, quality_model
from askbase.llm.common import sized, table, text_key, written
from askbase.llm.queries import DOMAIN_WEIGHTS, domain_labels, tokens_round_trip


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_model.fit_and_keep(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of n-gram near duplicates: five words, similarity 0.8 or more."""
    return ngram_join.one_of_each(docs, n=5, need=80, per=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    keyed = docs.withColumn("_leak_tk", text_key())
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), carry_key=True)
    hit = found.filter(F.size("hits") > 0).select(F.col("doc_id").alias("_leak_id"), F.col("tk").alias("_leak_key"))
    hit = written(hit.distinct(), "leaks")
    return keyed.join(sized(hit, 48), keyed["doc_id"].eqNullSafe(hit["_leak_id"]) & (
        keyed["_leak_tk"] == hit["_leak_key"]), "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the rates that meet the target weights; none is lost."""
    rates, report = mixing.mixing_rates(docs, domain_labels(spark, sf_dir), DOMAIN_WEIGHTS)
    return mixing.repeat_to_rates(docs, rates, report)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and per document what they hold."""
    return tokens_round_trip(spark, docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: Classifiers, connected components, a fit and a tokenizer: no SQL; tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
