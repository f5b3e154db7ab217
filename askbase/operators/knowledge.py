"""Knowledge base: flattening, label index, label joins.

The intents table has one row per intent:
``intent_pos int, tag string, patterns array<string>, responses array<string>,
context_set string``.  The flat QA table carries the three positions so that
document order survives every shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from askbase.functions.text import strip_text
from askbase.operators.sizing import sized_broadcast

QA_COLUMNS = ["Pattern", "Tag", "Response", "intent_pos", "pattern_pos", "response_pos"]
ORDER = ["intent_pos", "pattern_pos", "response_pos"]


def _fail_if(cond, message: str, value):
    return F.when(cond, F.raise_error(F.lit(message))).otherwise(value)


def flatten_intents(intents: DataFrame, lenient: bool = False) -> DataFrame:
    """Per intent, every pattern x every response, in document order.

    Two chained ``posexplode`` (a LATERAL VIEW): no join, no shuffle.  Strict
    mode fails like the reference on an intent without ``patterns``; lenient
    mode (P2) skips such intents.  A missing ``responses`` list fails in both
    modes once the intent has patterns; a missing tag fails once rows exist.
    """
    i = intents
    if lenient:
        i = i.filter(F.col("patterns").isNotNull())
    patterns = _fail_if(F.col("patterns").isNull(), "intent without patterns", F.col("patterns"))
    responses = _fail_if(F.col("responses").isNull() & (F.size(patterns) > 0),
                         "intent without responses", F.col("responses"))
    x = i.select("intent_pos", "tag", F.posexplode(patterns).alias("pattern_pos", "Pattern"),
                 responses.alias("responses"))
    x = x.select("intent_pos", "tag", "pattern_pos", "Pattern",
                 F.posexplode("responses").alias("response_pos", "Response"))
    return x.select("Pattern", _fail_if(F.col("tag").isNull(), "intent without tag", F.col("tag")).alias("Tag"),
                    "Response", "intent_pos", "pattern_pos", "response_pos")


def append_qa(base: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Bag union (duplicates kept), columns matched by name."""
    return base.unionByName(new_rows)


def preview(qa: DataFrame, n: int = 5) -> DataFrame:
    """First rows in document order (TakeOrdered, no full sort)."""
    return qa.orderBy(*ORDER).limit(n)


def pattern_scan(qa: DataFrame) -> DataFrame:
    """P5: the lower-cased pattern column with its document position."""
    return qa.select(F.lower("Pattern").alias("pattern_lower"), *ORDER)


def distinct_tags(qa: DataFrame) -> DataFrame:
    """A1: distinct tags with their first appearance (partial + final hash agg)."""
    return qa.groupBy(F.col("Tag").alias("tag")).agg(
        F.min(F.struct(*ORDER)).alias("first"))


def label_index(qa: DataFrame, strip: bool = True) -> DataFrame:
    """A2: dense ids 0..n-1 in first-appearance order.

    Columns: ``label_id, tag, label`` (label = stripped tag when ``strip``),
    ``label2id`` (two tags equal after stripping share the *last* id) and
    ``num_labels`` (counted before strip-merging).  Ids come from the
    distributed dense index over the distinct tags; the inverse map is a
    grouped max joined back (one row per label).
    """
    from askbase.operators.indexing import dense_index
    tags = distinct_tags(qa)
    ids = dense_index(tags, [F.col("first")], "label_id").select(
        F.col("label_id").cast("int").alias("label_id"), "tag",
        (strip_text("tag") if strip else F.col("tag")).alias("label"))
    inv = ids.groupBy("label").agg(F.max("label_id").alias("label2id"))
    n = tags.select(F.count(F.lit(1))).scalar()
    return ids.join(inv, "label").select("label_id", "tag", "label", "label2id",
                                        n.cast("int").alias("num_labels"))


def label_encode(qa: DataFrame, labels: DataFrame, strip: bool = True) -> DataFrame:
    """Map every QA row's tag to its id (broadcast join on the label table)."""
    lab = labels.select(F.col("label").alias("_label"), F.col("label2id").alias("labels")).distinct()
    key = strip_text("Tag") if strip else F.col("Tag")
    return (qa.withColumn("_label", key)
            .join(sized_broadcast(lab), "_label", "left")
            .drop("_label"))


def label_decode(preds: DataFrame, labels: DataFrame, id_col: str = "pred_id",
                 unseen: str | None = "unseen_tag", stripped: bool = True) -> DataFrame:
    """Class id -> label.  A model trained on this table knows the
    *stripped* labels (``stripped=True``, the reference's behaviour); ids
    outside the table map to ``unseen``."""
    lab = labels.select(F.col("label_id").alias(id_col),
                        F.col("label" if stripped else "tag").alias("pred_tag"))
    out = preds.join(sized_broadcast(lab), id_col, "left")
    if unseen is not None:
        out = out.withColumn("pred_tag", F.coalesce("pred_tag", F.lit(unseen)))
    return out


def tags_without_responses(intents: DataFrame) -> DataFrame:
    """Tags present in the intents but with no response row in the flat table."""
    all_tags = intents.select(F.col("tag")).distinct()
    flat_tags = flatten_intents(intents, lenient=True).select(F.col("Tag").alias("tag")).distinct()
    return all_tags.join(flat_tags, "tag", "left_anti")


class KnowledgeBase:
    """The knowledge base flattened once and kept for every question batch.

    ``qa`` is persisted (memory, spilling to disk); derived tables (labels,
    pattern index) are built lazily from it.  Lineage back to the source
    intents is kept, so a lost executor recomputes its blocks.
    """

    def __init__(self, intents: DataFrame, lenient: bool = False, persist: bool = True):
        from pyspark import StorageLevel
        self.intents = intents
        qa = flatten_intents(intents, lenient)
        self.qa = qa.persist(StorageLevel.MEMORY_AND_DISK) if persist else qa
        self._labels = None
        self._index = None
        self._responses = {}

    @property
    def labels(self) -> DataFrame:
        """The label table, persisted."""
        if self._labels is None:
            from pyspark import StorageLevel
            self._labels = label_index(self.qa).persist(StorageLevel.MEMORY_AND_DISK)
        return self._labels

    def response_table(self, strip_tags: bool = False):
        """(tag -> n_rows, (tag, ordinal) -> response), built once."""
        if strip_tags not in self._responses:
            from pyspark import StorageLevel
            from askbase.operators.answer import tag_response_table
            counts, rows = tag_response_table(self.qa, strip_tags)
            counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
            self._responses[strip_tags] = (sized_broadcast(counts), sized_broadcast(rows))
        return self._responses[strip_tags]

    def close(self) -> None:
        """Release the cached tables (the lineage stays valid)."""
        self.qa.unpersist()
        if self._labels is not None:
            self._labels.unpersist()
            self._labels = None
        if self._index is not None:
            self._index.df.unpersist()
        for counts, rows in self._responses.values():
            counts.unpersist()
            rows.unpersist()
        self._responses.clear()
        self._index = None

    def pattern_index(self, max_bytes: int | None = None):
        if self._index is None:
            from askbase.operators.gate import build_pattern_index
            self._index = build_pattern_index(self.intents, max_bytes)
        return self._index
