"""Word-level encoding.

The vocabulary is ``groupBy(token).count`` (partial aggregation), ranked by
(count desc, token) with a distributed dense index; id 0 is padding, ids
start at 1.  Rows are encoded by exploding their tokens, joining the
vocabulary (AQE broadcasts a small one) and regrouping per row in token order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from askbase.constants import MAX_LEN_TRAIN
from askbase.functions.text import tokenize_clean
from askbase.operators.indexing import dense_index


def vocabulary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The vocabulary of a training set: ``token, id``, the most frequent first."""
    tokens = df.select(F.explode(tokenize_clean(text_col)).alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return dense_index(counts, [F.col("n").desc(), F.col("token")], "id", start=1).select("token", "id")


def encode_pad(df: DataFrame, key_cols: list[str], text_col: str = "text", max_len: int = MAX_LEN_TRAIN,
               vocab: DataFrame | None = None) -> DataFrame:
    """``input_ids`` (truncated to ``max_len``, padded with 0 to the
    longest row of the set) and ``attention_mask`` (1 per token, 0 per pad).

    ``vocab``: the vocabulary of the training set, for texts that are scored
    later (``max_len=MAX_LEN_SERVE``); a word that it lacks gets the id after its last.
    Without it, the vocabulary of ``df`` itself.  A null or empty text is all
    padding; ``key_cols`` identify a row.
    """
    if vocab is None:
        vocab = vocabulary(df, text_col)
    # truncation first: only a row's first max_len tokens are joined and regrouped
    words = df.select(*key_cols, F.slice(tokenize_clean(text_col), 1, max_len).alias("_w"))
    longest = words.select(F.coalesce(F.max(F.size("_w")), F.lit(0))).scalar()
    unknown = vocab.select(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
    vocab = vocab.select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    head = words.select(*key_cols, F.posexplode_outer("_w").alias("_pos", "_token"))
    found = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_id", unknown).cast("int").alias("id")))
    ids = head.join(vocab, "_token", "left").groupBy(*key_cols).agg(F.sort_array(F.collect_list(found)).alias("_p"))
    ids = ids.select(*key_cols, F.transform("_p", lambda s: s["id"]).alias("_ids"))
    pad = longest - F.size("_ids")
    return ids.select(*key_cols,
                      F.concat("_ids", F.array_repeat(F.lit(0), pad)).alias("input_ids"),
                      F.concat(F.transform("_ids", lambda x: F.lit(1)), F.array_repeat(F.lit(0), pad))
                      .alias("attention_mask"))


def zip_examples(encoded: DataFrame, labels: DataFrame, key_cols: list[str], label_col: str = "label") -> DataFrame:
    """One training record per row: ids, mask and label."""
    return encoded.join(labels.select(*key_cols, label_col), key_cols).select(
        *key_cols, "input_ids", "attention_mask", F.col(label_col).alias("labels"))
