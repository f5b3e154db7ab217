"""The operators as registered queries, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from askbase.llm import (decontaminate, graph_index, html_extract, license_scan, line_dedup, mixing, ngram_join, prefix_trie,
                         quality_model, quality_rules, token_counts, token_store, whitening)
from askbase.llm.common import table
from askbase.session import scratch_path

END_ID, TOKEN_LIMIT = 2, 1024
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Share of tokens that each language is to have.
DOMAIN_WEIGHTS = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, need=90, per=100)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_round_trip(spark, table(spark, sf_dir, "documents"))


def tokens_round_trip(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the documents' token files in the shared folder and read them back."""
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(docs, path, public_tokenizers.path(WORD_BPE), END_ID)
    return token_store.read_back(spark, path)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled table of domains: the language of the documents that ``labels`` covers."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(labels, "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates, _ = mixing.mixing_rates(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), DOMAIN_WEIGHTS)
    return rates.select("doc_id", "n_tokens", "domain", F.transform("posterior", lambda p: F.round(p, 6)).alias("posterior"),
                        F.round("rate", 6).alias("rate"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.rank_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.borrow_heads(turns))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_index.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), count=8)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_html_extraction, op2_ngram_jaccard, op3_token_output, op4_decontamination, op5_token_counts, op6_mixing,
           op7_quality_classifier, op8_line_dedup, op9_quality_rules, op10_license_scan, op11_prefix_trie, op12_nearest_neighbours,
           op13_whitening, pipeline)
    return {f.__name__: f for f in own}
