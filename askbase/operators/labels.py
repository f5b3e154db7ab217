"""Label tables that belong to a model.

A class id means what the model's own table says, whatever the knowledge base
looks like by the time a question is asked.  So the table is saved with the
model, ids are never given anew, and serving decodes with it; only then is the
decoded tag looked up in the knowledge base being served (J1).

Columns: those of ``label_index`` (``label_id, tag, label, label2id,
num_labels``) and ``since``, the version that introduced the id.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from askbase.functions.text import strip_text
from askbase.operators.indexing import dense_index
from askbase.operators.knowledge import distinct_tags, label_decode, label_index
from askbase.sources.commit_log import CommitLog


def extend_labels(known: DataFrame | None, qa: DataFrame) -> DataFrame:
    """The label table for a model to be trained on ``qa``, after ``known``.

    Ids in ``known`` stay, also those of tags that ``qa`` no longer has; tags that are
    new follow the largest id in first-appearance order.
    """
    if known is None:
        return label_index(qa).withColumn("since", F.lit(1))
    last = known.agg(F.max("label_id").alias("id"), F.max("since").alias("since")).first()
    new = distinct_tags(qa).join(known.select("tag"), "tag", "left_anti")
    new = dense_index(new, [F.col("first")], "label_id", (-1 if last["id"] is None else last["id"]) + 1)
    new = new.select(F.col("label_id").cast("int").alias("label_id"), "tag", strip_text("tag").alias("label"),
                     F.lit((last["since"] or 0) + 1).alias("since"))
    both = known.select("label_id", "tag", "label", "since").unionByName(new)
    inv = both.groupBy("label").agg(F.max("label_id").alias("label2id"))
    n = both.select(F.count(F.lit(1))).scalar()
    return both.join(inv, "label").select("label_id", "tag", "label", "label2id", n.cast("int").alias("num_labels"), "since")


def decoded(predict, labels: DataFrame):
    """``predict`` (adds ``pred_id``) with the label of that id in its own ``labels`` as ``pred_tag``."""
    return lambda df: label_decode(predict(df), labels, "pred_id")


@dataclass
class TrainedModel:
    """A fitted pipeline and the label table it was trained with."""

    pipeline: PipelineModel
    labels: DataFrame
    version: int = 0

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``pred_id`` and ``pred_tag`` to a table with ``text``: what ``answer_questions`` asks for."""
        from askbase.operators.classify import model_predictor
        return decoded(model_predictor(self.pipeline), self.labels)(df)


class ModelStore:
    """Versions of a model under a folder; a version is its pipeline and its labels, or nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)

    def save(self, pipeline: PipelineModel, labels: DataFrame) -> int:
        """Publish a new version; its number."""
        folder = uuid.uuid4().hex
        pipeline.write().save(f"{self.log.path}/data/{folder}/pipeline")
        labels.write.parquet(f"{self.log.path}/data/{folder}/labels")
        while True:
            version = self.log.latest()[0] + 1
            if self.log.publish(version, {"folder": folder}):
                return version

    def load(self, version: int | None = None) -> TrainedModel:
        """The newest version, or the one asked for."""
        if version is None:
            version, _ = self.log.latest()
        if not version:
            raise FileNotFoundError(f"no model has been saved at {self.log.path}")
        folder = f"{self.log.path}/data/{self.log.read(version)['folder']}"
        return TrainedModel(PipelineModel.load(f"{folder}/pipeline"), self.spark.read.parquet(f"{folder}/labels"), version)

    def labels(self) -> DataFrame | None:
        """Label table of the newest version, None before the first."""
        return self.load_labels(self.log.latest()[0]) if self.log.latest()[0] else None

    def load_labels(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.log.path}/data/{self.log.read(version)['folder']}/labels")


def retrain(store: ModelStore, kb, **options) -> tuple[TrainedModel, DataFrame]:
    """Train on ``kb`` under ``store``'s label table extended by the new tags, and publish; with the held-out rows."""
    from askbase.operators.classify import train_on_knowledge_base
    labels = extend_labels(store.labels(), kb.qa)
    pipeline, held_out = train_on_knowledge_base(kb, labels=labels, **options)
    return store.load(store.save(pipeline, labels)), held_out
