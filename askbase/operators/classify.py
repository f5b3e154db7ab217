"""Classification.

C1 re-aims the transformer fine-tune as a distributed Spark ML pipeline
(tokenize -> hashed term counts -> IDF -> multinomial logistic regression).  C2-C4
are native array expressions over class scores, so any model that emits a
score vector (or the fixture's stand-ins) goes through the same plan.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

# Width of the hashed word counts (C1): every word has a place, at any size of
# the vocabulary; words that share one are counted together.
HASH_FEATURES = 1 << 18


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def softmax(df: DataFrame, col: str, out: str = "probs") -> DataFrame:
    """Probabilities, shifted by the row maximum for stability."""
    def once(value, use):      # a lambda argument is evaluated once, a column in a lambda for every element
        return F.transform(F.array(value), use)[0]

    shifted = once(F.array_max(col), lambda m: F.transform(col, lambda v: F.exp(v - m)))
    return df.withColumn(out, once(shifted, lambda ex: once(
        F.aggregate(ex, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(ex, lambda v: v / total))))


def argmax(x) -> Column:
    """Index of the largest value, first one on ties (0-based)."""
    x = _c(x)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def linear_scores(df: DataFrame, key_cols: list[str], features: str, weights: DataFrame,
                  out: str = "scores") -> DataFrame:
    """C4: ``key_cols`` and ``scores``, where scores[i] = <features, weights of the
    i-th class> in ascending class order.

    ``weights``: ``class, dim, w``.  The features meet the weights of their
    dimension in an equi-join (a model that fits is broadcast by AQE); the
    products of a row are summed before the shuffle, so one number per row and
    class moves.  A row without features has no scores (an empty array); the
    weights hold every dimension of every class.
    """
    x = df.select(*key_cols, F.posexplode_outer(features).alias("dim", "_x"))
    s = x.join(weights, "dim", "left").groupBy(*key_cols, "class").agg(F.sum(F.col("_x") * F.col("w")).alias("_s"))
    found = F.when(F.col("class").isNotNull(), F.struct("class", "_s"))
    return s.groupBy(*key_cols).agg(F.transform(F.sort_array(F.collect_list(found)), lambda c: c["_s"]).alias(out))


def centroid_weights(df: DataFrame, features: str, label: str) -> DataFrame:
    """Per-class mean vectors as a table: ``class, dim, w``."""
    x = df.select(F.col(label).alias("class"), F.posexplode(features).alias("dim", "_x"))
    return x.groupBy("class", "dim").agg(F.avg("_x").alias("w"))


def classifier_stages(text_col: str = "text", label_col: str = "label", reg: float = 0.01,
                      max_iter: int = 100, width: int = HASH_FEATURES) -> Pipeline:
    """Word tokens (same word rule as T3) -> hashed counts -> IDF -> multinomial LR."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", gaps=False,
                         pattern=r"[\p{L}\p{N}_]+", toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=width)
    idf = IDF(inputCol="_tf", outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol=label_col, family="multinomial",
                            regParam=reg, maxIter=max_iter, predictionCol="prediction",
                            probabilityCol="probability")
    return Pipeline(stages=[tok, tf, idf, lr])


def train_classifier(train: DataFrame, text_col: str = "text", label_col: str = "label", **kw) -> PipelineModel:
    return classifier_stages(text_col, label_col, **kw).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Score with the fitted pipeline; ``pred`` int and ``probs`` array<double>."""
    out = model.transform(df)
    return (out.withColumn("pred", F.col("prediction").cast("int"))
            .withColumn("probs", vector_to_array("probability"))
            .drop("_tokens", "_tf", "_features", "rawPrediction", "probability", "prediction"))


def train_on_knowledge_base(kb, seed: int = 123, test_fraction: float = 0.25, labels: DataFrame | None = None,
                            **kw) -> tuple[PipelineModel, DataFrame]:
    """C1 as the reference trains it: the flattened rows' *unstemmed* patterns
    as text, the stripped tag's id (J4) as label, fitted on the train side of
    the seeded split (R2).  Returns the model and the held-out rows.  ``labels``:
    the label table to train under (see ``labels.extend_labels``), by default the
    knowledge base's own; save it with the model."""
    from askbase.operators.evaluate import train_test_split
    from askbase.operators.knowledge import ORDER, label_encode
    enc = label_encode(kb.qa, kb.labels if labels is None else labels).select(F.col("Pattern").alias("text"),
                                                F.col("labels").cast("double").alias("label"), *ORDER)
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ORDER])
    split = train_test_split(enc, key, seed, test_fraction)
    model = train_classifier(split.filter(F.col("split") == "train"), "text", "label", **kw)
    return model, split.filter(F.col("split") == "test")


def model_predictor(model: PipelineModel, text_col: str = "text"):
    """Adds ``pred_id``; ``labels.decoded`` makes it a ``predict`` for ``answer_questions``."""
    def predict(df: DataFrame) -> DataFrame:
        scored = predict_frame(model, df, text_col)
        return scored.withColumnRenamed("pred", "pred_id").drop("probs")
    return predict


def predict_frame(model: PipelineModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    src = df if text_col == "text" else df.withColumn("text", F.col(text_col))
    return predict(model, src)


def save_model(model: PipelineModel, path: str, labels: DataFrame | None = None) -> None:
    """Persist the fitted pipeline (tokenizer and vocabulary included)
    and, when given, the label table (``label_id, tag, label``) beside it."""
    model.write().overwrite().save(path)
    if labels is not None:
        labels.write.mode("overwrite").parquet(path.rstrip("/") + "_labels")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_labels(spark, path: str) -> DataFrame:
    """The label table saved beside a model by ``save_model``."""
    return spark.read.parquet(path.rstrip("/") + "_labels")
