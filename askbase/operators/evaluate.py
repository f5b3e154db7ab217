"""Evaluation, splitting and ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from askbase import constants as K
from askbase.operators.indexing import dense_index, group_rank


def accuracy(preds: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """A3: share of exact matches."""
    return preds.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("Accuracy"))


def confusion_counts(preds: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """A5: (label, pred) pair counts; map-side partial aggregation."""
    return preds.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class(preds: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per-class tp/fp/fn/precision/recall/F1 over every class seen in labels
    or predictions; empty denominators give 0."""
    cc = confusion_counts(preds, label, pred)
    both = cc.select(F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"),
                 F.when(F.col("label") != F.col("pred"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(F.col("label") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"),
                 F.lit(0).cast("bigint").alias("fn")))).alias("s")).select("s.*")
    g = both.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    g = g.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return g.withColumn("f1", f1)


def macro_prf(preds: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """A4: unweighted means of per-class precision, recall and F1."""
    pc = per_class(preds, label, pred)
    return pc.agg(F.avg("precision").alias("Precision"), F.avg("recall").alias("Recall"),
                  F.avg("f1").alias("F1"))


def metrics(preds: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """A3 + A4 in one row (Accuracy, F1, Precision, Recall), from one pass of
    per-class counts: every row is counted once in its label's tp + fn."""
    pc = per_class(preds, label, pred)
    return pc.agg((F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("Accuracy"),
                  F.avg("f1").alias("F1"), F.avg("precision").alias("Precision"),
                  F.avg("recall").alias("Recall"))


def best_checkpoint(history: DataFrame, every: int = K.EVAL_EVERY_STEPS) -> DataFrame:
    """Among evaluations every ``every`` steps, the lowest loss; ties go
    to the earliest step."""
    h = history.filter(F.col("step") % every == 0)
    return h.agg(F.min(F.struct("loss", "step")).alias("b")).select(
        F.col("b.step").alias("step"), F.col("b.loss").alias("loss"))


def _split_hash(key: Column, seed) -> Column:
    from askbase.operators.answer import md5_bucket
    return md5_bucket(F.lit(str(seed)), key)


def train_test_split(df: DataFrame, key: Column, seed: int = K.SPLIT_SEED,
                     test_fraction: float = K.TEST_FRACTION, exact: bool = True) -> DataFrame:
    """R2: adds ``split`` in {'train','test'}.

    Rows are ordered by (md5(seed:key) bucket, key); ``key`` must identify a
    row.  Exact mode sends the first ceil(fraction * n) rows to test without
    sorting the table: a histogram of the hash's top 16 bits (at most 65,536
    counts reach the driver) finds the bucket that holds the cut, only that
    bucket is ranked, and every row is then compared with the cut value.
    Scale mode: hash below the fraction of 2**32 (one pass, count approximate).
    """
    h = _split_hash(key, seed)
    if not exact:
        cut = int(test_fraction * (1 << 32))
        return df.withColumn("split", F.when(h < cut, "test").otherwise("train"))
    cols = df.columns
    d = df.withColumn("_h", h).withColumn("_k", key.cast("string"))
    b = F.shiftright(F.col("_h"), 16)
    hist = sorted((r["_b"], r["n"]) for r in d.groupBy(b.alias("_b")).agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(c for _, c in hist)
    n_test = math.ceil(test_fraction * n)
    if n_test == 0 or n_test == n:
        return df.withColumn("split", F.lit("test" if n_test else "train"))
    seen = 0
    for bucket, c in hist:
        if seen + c >= n_test:
            break
        seen += c
    need = n_test - seen                      # rows of this bucket that go to test (1..c)
    inside = d.filter(b == bucket).select("_h", "_k")
    ranked = dense_index(inside, [F.col("_h"), F.col("_k")], "_r")
    cut = ranked.filter(F.col("_r") == need - 1).select("_h", "_k").first()
    is_test = ((b < bucket) | ((b == bucket) & ((F.col("_h") < cut["_h"]) |
               ((F.col("_h") == cut["_h"]) & (F.col("_k") <= cut["_k"])))))
    return d.withColumn("split", F.when(is_test, "test").otherwise("train")).select(*cols, "split")


def split_leakage(split_df: DataFrame, col: str = "Pattern") -> DataFrame:
    """Test rows whose pattern also occurs in the train half."""
    test = split_df.filter(F.col("split") == "test").select(col)
    train = (split_df.filter(F.col("split") == "train").select(col).distinct()
             .withColumn("_leak", F.lit(1)))
    return test.join(train, col, "left").agg(
        F.count(F.lit(1)).alias("n_test"), F.coalesce(F.sum("_leak"), F.lit(0)).cast("bigint").alias("n_leaked"))


def chat_latest_first(chat: DataFrame) -> DataFrame:
    """Display position from the newest turn, per conversation."""
    r = group_rank(chat, ["conv_id"], [F.col("turn").desc()], "display_pos")
    return r.withColumn("display_pos", F.col("display_pos").cast("int"))
