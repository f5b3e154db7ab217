"""A classifier of word counts (C1 beside the Spark ML pipeline).

Multinomial naive Bayes with one added to every count: training is two grouped
counts, so the model is a pair of small tables, exact and the same on every run, and SQL can
restate it.  A class's score of a text is

    ln(rows of the class / rows) + sum over the words of ln(count + 1)
        - words * ln(words of the class + distinct words + 1)

rounded to nine places; of equal scores the smallest class wins.  Words that training
has not seen count 0 in every class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from askbase.functions.text import tokenize_clean
from askbase.operators.sizing import sized_broadcast
from askbase.session import scratch_path


@dataclass
class CountModel:
    """``classes``: label, n_rows, n_words, and in every row all_rows and vocabulary; ``words``: token, label, n."""

    classes: DataFrame
    words: DataFrame

    def save(self, path: str) -> None:
        self.classes.write.parquet(f"{path}/classes")
        self.words.write.parquet(f"{path}/words")

    @classmethod
    def load(cls, spark, path: str) -> CountModel:
        return cls(spark.read.parquet(f"{path}/classes"), spark.read.parquet(f"{path}/words"))


def fit(train: DataFrame, text_col: str = "text", label_col: str = "label") -> CountModel:
    """Counts of ``train``; rows without a label are left out.  The tables are written once."""
    spark = train.sparkSession
    rows = train.select(F.col(label_col).cast("int").alias("label"), tokenize_clean(text_col).alias("t")).filter("label is not null")
    # explode_outer keeps rows without words in the counts of their class
    per = rows.select("label", F.explode_outer("t").alias("token"), F.size(F.coalesce("t", F.array().cast("array<string>"))).alias("l"))
    words = per.filter("token is not null").groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "counts")
    words.write.parquet(f"{path}/words")
    words = spark.read.parquet(f"{path}/words")
    n_rows = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    n_words = words.groupBy("label").agg(F.sum("n").alias("n_words"))
    classes = n_rows.join(n_words, "label", "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))
    totals = n_rows.select(F.sum("n_rows")).scalar().alias("all_rows")
    vocabulary = words.select(F.count_distinct("token")).scalar().alias("vocabulary")
    classes.select("*", totals, vocabulary).write.parquet(f"{path}/classes")
    return CountModel(spark.read.parquet(f"{path}/classes"), words)


def predict(model: CountModel, df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys``, ``pred`` and ``score`` per row of ``df``; ``keys`` name a row.  No class: no rows.

    Words meet their counts in an equi-join, and the sums of a row and class are added up before
    the shuffle; the classes come as one array, as there are few."""
    t = df.select(*keys, tokenize_clean(text_col).alias("t")).withColumn("l", F.coalesce(F.size("t"), F.lit(0)))
    t = t.withColumn("l", F.greatest("l", F.lit(0)))
    hits = t.select(*keys, F.explode("t").alias("token")).join(sized_broadcast(model.words), "token")
    sums = hits.groupBy(*keys, "label").agg(F.sum(F.log(F.col("n") + 1.0)).alias("s"))
    sums = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("label", "s"))).alias("_s"))
    per_class = model.classes.select(F.collect_list(F.struct(
        "label", F.log(F.col("n_rows") / F.col("all_rows")).alias("prior"),
        F.log(F.col("n_words") + F.col("vocabulary") + 1.0).alias("size")))).scalar()
    scored = t.select(*keys, "l").join(sums, keys, "left").withColumn("_c", F.explode(per_class))
    score = F.col("_c.prior") + F.coalesce(F.try_element_at("_s", F.col("_c.label")), F.lit(0.0)) - F.col("l") * F.col("_c.size")
    best = scored.select(*keys, F.col("_c.label").alias("label"), F.round(score, 9).alias("score")).groupBy(*keys).agg(
        F.min(F.struct((-F.col("score")).alias("low"), "label")).alias("b"))
    return best.select(*keys, F.col("b.label").alias("pred"), (-F.col("b.low")).alias("score"))
