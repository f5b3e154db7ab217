"""Unknown-question handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from askbase.operators.knowledge import flatten_intents
from askbase.sources.unknown_store import UnknownStore, export_intents, with_positions


def log_unknown(spark: SparkSession, batch: DataFrame, path: str, question_col: str = "question",
                arrival_col: str = "arrival") -> DataFrame:
    """Insert every absent question in its original casing; ids continue
    densely after the current maximum in arrival order; ``answer`` is null; nulls
    are ignored.  Idempotent (replaying a batch adds nothing) and safe under
    several writers.  Returns the rows added."""
    return UnknownStore(spark, path).insert_absent(
        batch.select(F.col(question_col).alias("question"), F.col(arrival_col).alias("arrival")))


def unknown_sites(answers: DataFrame) -> DataFrame:
    """The unknown questions of an answered batch with their reason."""
    return answers.filter(F.col("is_unknown")).select("question_id", "reason")


def fallback_answers(answers: DataFrame) -> DataFrame:
    """The fixed apology for every unknown."""
    return answers.filter(F.col("is_unknown")).select("question_id", "answer")


def merge_answered(intents: DataFrame, unknown: DataFrame) -> DataFrame:
    """U4: the exported unknowns appended after the knowledge base's intents,
    then flattened; all share the constant tag, hence one response pool."""
    n = intents.select(F.max("intent_pos")).scalar()
    exported = with_positions(export_intents(unknown))
    merged = intents.select("intent_pos", "tag", "patterns", "responses", "context_set").unionByName(
        exported.withColumn("intent_pos", (F.col("intent_pos") + F.coalesce(n, F.lit(-1)) + 1).cast("int")))
    return flatten_intents(merged)
