"""Line dedup (operator 8): levelled sorted runs of line hashes.

``LineRuns`` keeps, per batch of documents, one run: (key hash, documents
with the key, whether an earlier run had it), sorted by hash.  A new batch is
merge-joined against the runs: keys that miss (the anti join) are new, the
others count up.  When a level holds ``fanout`` runs they are merged into one
run of the next level, so a key is rewritten O(log batches) times.

``drop_frequent_lines`` removes the lines whose key occurs in at least
``min_docs`` documents of all batches.

Rows and edge cases: null text is one empty line; a row is a document, also
when its id is null or repeated; keys under ``min_chars`` code points are
never dropped; extra input columns are ignored; an empty table gives none.

A key is 128 bits of hash, never the line itself.  Hot lines are summed on the
map side; the join back carries (row, line number) only, and its hot keys are
split by AQE, as nothing in that stage needs a key's rows together.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askbase.llm.common import text_key, written
from askbase.session import scratch_path

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN_SCHEMA = "h1 long, h2 long, n long, is_new boolean"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER)


def line_table(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """One row per line that has a key: (batch, doc_id, tk, pos, h1, h2)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", text_key())
    lines = rows.select("doc_id", "tk", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "tk", "pos", line_key(F.col("line")).alias("key")).filter(
        F.length("key") >= min_chars)
    return keyed.select(F.pmod(F.col("tk.a"), F.lit(batches)).cast("int").alias("batch"), "doc_id", "tk", "pos",
                        F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))


class LineRuns:
    """Levelled runs of line hashes in the shared folder.  The driver holds
    only their paths."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    def merged(self) -> DataFrame:
        """(h1, h2, n): documents per key over all runs."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def ingest(self, keys: DataFrame) -> str:
        """Add a batch: ``keys`` has (h1, h2) once per document with the key.
        Returns the path of the batch's own run."""
        counts = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        known = self.merged().select("h1", "h2", F.lit(True).alias("known"))
        run = counts.join(known, ["h1", "h2"], "left").select(
            "h1", "h2", "n", F.col("known").isNull().alias("is_new"))
        path = self._write(run)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(path)
        self._compact()
        return path

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` (with h1, h2) whose key no run has."""
        return lines.join(self.merged().select("h1", "h2"), ["h1", "h2"], "left_anti")

    def _write(self, run: DataFrame) -> str:
        path = scratch_path(self.spark, "line-run")
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            both = self.spark.read.schema(RUN_SCHEMA).parquet(*self.levels[level])
            run = both.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("is_new").alias("is_new"))
            path = self._write(run.select("h1", "h2", "n", "is_new"))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level] = []
            self.levels[level + 1].append(path)
            level += 1


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4,
                        fanout: int = 2) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept_text) for every row of ``docs``."""
    spark = docs.sparkSession
    lines = written(line_table(docs, batches, min_chars), "lines", ["batch"])
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        own = lines.filter(F.col("batch") == b)
        # a document (row) counts once per key; identical rows are told apart by their number
        per_doc = own.groupBy("doc_id", "tk", "h1", "h2", "pos").agg(F.count(F.lit(1)).alias("copies"))
        per_doc = per_doc.groupBy("doc_id", "tk", "h1", "h2").agg(F.max("copies").alias("copies"))
        runs.ingest(per_doc.select("h1", "h2", F.explode(F.sequence(F.lit(1), F.col("copies")))))
    # a table of its own: joined as an exchange, so that AQE can split a hot line's rows
    frequent = written(runs.merged().filter(F.col("n") >= min_docs).select("h1", "h2"), "frequent")
    gone = lines.join(frequent, ["h1", "h2"], "left_semi").select("doc_id", "tk", "pos")
    gone = gone.groupBy("doc_id", "tk").agg(F.collect_set("pos").alias("gone"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", text_key())
    joined = rows.alias("r").join(
        gone.alias("g"), F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.tk") == F.col("g.tk")), "left")
    joined = joined.select("r.doc_id", "r.text", F.col("g.gone").alias("gone"))
    return joined.mapInArrow(_rebuild, "doc_id long, text string, n_lines long, n_dropped long, kept_text string")


def _rebuild(batches):
    for b in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            lines = text.split("\n")
            out = set(gone or ())
            n_lines.append(len(lines))
            n_dropped.append(len(out))
            kept.append(text if not out else "\n".join(x for i, x in enumerate(lines) if i not in out))
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(n_lines, pa.int64()),
             pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "text", "n_lines", "n_dropped", "kept_text"])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
