"""The unknown-question table and its exports.

``UnknownStore`` keeps ``id bigint, question string not null, answer string`` with
``question`` unique under any number of writers:

* Rows lie in ``data/commit=<name>/bucket=<k>``, the bucket being a hash of the question.
  An insert reads only the buckets that its own questions fall into.
* A commit's rows hold their place within the commit; the first id of every commit is
  in the manifest.  Two writers can therefore prepare at the same time: the one that
  publishes second (see ``commit_log``) takes the next ids, and prepares again only
  the questions that the first has stored meanwhile.
* Data folders that no manifest names are never read; ``vacuum`` removes them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from askbase import constants as K, schemas
from askbase.operators.indexing import dense_index
from askbase.session import scratch_path
from askbase.sources.commit_log import CommitLog

#: Buckets of a new store; a stored one keeps its own number.
BUCKETS = 64
#: Commits after which an insert rewrites them as one.
COMPACT_AFTER = 32

_STORED = "place bigint, question string, answer string, commit string, bucket int"


class UnknownStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.log = CommitLog(spark, path)
        self.path = self.log.path

    def state(self) -> tuple[int, dict]:
        version, manifest = self.log.latest()
        return version, manifest or {"buckets": self.buckets, "next_id": 1, "commits": []}

    # ------------------------------------------------------------------ reading

    def _rows(self, commits: list[dict], buckets: list[int] | None = None) -> DataFrame:
        """``id, question, answer, commit, bucket`` of some commits, of some buckets only if given."""
        if not commits:
            return self.spark.createDataFrame([], "id bigint, question string, answer string, commit string, bucket int")
        folders = [f"{self.path}/data/commit={c['name']}" for c in commits]
        df = self.spark.read.schema(_STORED).option("basePath", f"{self.path}/data").parquet(*folders)
        if buckets is not None:
            df = df.filter(F.col("bucket").isin(buckets))
        start = F.create_map(*[F.lit(v) for c in commits for v in (c["name"], c["start"])])
        return df.select((F.col("place") + F.element_at(start, F.col("commit"))).alias("id"), "question", "answer", "commit", "bucket")

    def scan(self) -> DataFrame:
        """The whole table."""
        return self._rows(self.state()[1]["commits"]).select("id", "question", "answer")

    def bucket_of(self, question, buckets: int):
        return F.pmod(F.xxhash64(question), F.lit(buckets)).cast("int")

    # ------------------------------------------------------------------ writing

    def _write(self, rows: DataFrame, buckets: int) -> str:
        """``place, question, answer`` as the data folder of a commit to come; its name."""
        name = uuid.uuid4().hex
        out = rows.withColumn("bucket", self.bucket_of("question", buckets)).repartition("bucket")
        out.write.partitionBy("bucket").parquet(f"{self.path}/data/commit={name}")
        return name

    def replace(self, table: DataFrame) -> None:
        """Make ``id, question, answer`` (ids from 1 on) the content of the store."""
        rows = table.select((F.col("id") - 1).cast("bigint").alias("place"), "question", F.col("answer").cast("string"))
        name = self._write(rows, self.state()[1]["buckets"])
        top = self.spark.read.schema("place bigint").parquet(f"{self.path}/data/commit={name}").agg(F.max("place")).first()[0]
        commits = [] if top is None else [{"name": name, "start": 1}]
        while True:
            version, now = self.state()
            if self.log.publish(version + 1, now | {"commits": commits, "next_id": top + 2 if commits else 1}):
                return

    def reset(self) -> None:
        """An empty table whose ids start at 1 again."""
        while True:
            version, now = self.state()
            if self.log.publish(version + 1, now | {"commits": [], "next_id": 1}):
                return

    def insert_absent(self, questions: DataFrame) -> DataFrame:
        """Store the ``question`` s that are not there yet, in order of ``arrival``.

        Nulls are ignored, a question counts once (case-sensitively) with its first
        arrival; ids go on densely.  Returns the rows added.
        """
        version, now = self.state()
        buckets = now["buckets"]
        first = questions.filter(F.col("question").isNotNull()).groupBy("question").agg(F.min("arrival").alias("arrival"))
        batch = f"{scratch_path(self.spark, 'unknown-batch')}"
        first.withColumn("bucket", self.bucket_of("question", buckets)).write.parquet(batch)
        asked = self.spark.read.parquet(batch)
        against = now["commits"]
        while True:
            touched = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())
            name = None
            if touched:
                stored = self._rows(against, touched).select("bucket", "question")
                asked_path = f"{scratch_path(self.spark, 'unknown-fresh')}"
                asked.join(stored, ["bucket", "question"], "left_anti").write.parquet(asked_path)
                asked = self.spark.read.schema(asked.schema).parquet(asked_path)
                rows = dense_index(asked, [F.col("arrival"), F.col("question")], "place").select(
                    "place", "question", F.lit(None).cast("string").alias("answer"))
                name = self._write(rows, buckets)
                n = self.spark.read.schema("place bigint").parquet(f"{self.path}/data/commit={name}").count()
            if name is None or not n:
                return self.spark.createDataFrame([], schemas.UNKNOWN)
            while True:
                mine = {"name": name, "start": now["next_id"]}
                if self.log.publish(version + 1, now | {"commits": [*now["commits"], mine], "next_id": now["next_id"] + n}):
                    if len(now["commits"]) >= COMPACT_AFTER:
                        self.compact()
                    return self._rows([mine]).select("id", "question", "answer")
                seen, (version, now) = now, self.state()
                if now["buckets"] != buckets:
                    raise RuntimeError("the store was laid out anew while rows were inserted")
                known = {c["name"] for c in seen["commits"]}
                against = [c for c in now["commits"] if c["name"] not in known]
                if self._rows(against, touched).join(asked, ["bucket", "question"], "left_semi").limit(1).count():
                    break           # another writer has stored some of them: leave those out

    def compact(self) -> bool:
        """Rewrite all commits as one; False if another writer published meanwhile."""
        version, now = self.state()
        rows = self._rows(now["commits"]).select((F.col("id") - 1).alias("place"), "question", "answer")
        name = self._write(rows, now["buckets"])
        return self.log.publish(version + 1, now | {"commits": [{"name": name, "start": 1}]})

    def vacuum(self) -> int:
        """Remove data folders that the latest version does not name.  Run it when no insert is under way."""
        live = {f"commit={c['name']}" for c in self.state()[1]["commits"]}
        dead = [f for f in self.log.data_folders() if f not in live]
        for f in dead:
            self.log.remove(f)
        return len(dead)


def reset_unknown(spark: SparkSession, path: str) -> DataFrame:
    """Drop and recreate the table empty (an explicit call, never an import
    side effect)."""
    UnknownStore(spark, path).reset()
    return scan_unknown(spark, path)


def write_unknown(table: DataFrame, path: str) -> None:
    """``id, question, answer`` as the content of the store at ``path``."""
    UnknownStore(table.sparkSession, path).replace(table)


def scan_unknown(spark: SparkSession, path: str) -> DataFrame:
    """Full scan of the table."""
    return UnknownStore(spark, path).scan()


def export_intents(unknown: DataFrame) -> DataFrame:
    """Each stored question becomes one intent with the constant tag;
    null and empty answers both become ''.  Position = id order."""
    ans = F.when(F.col("answer").isNull() | (F.col("answer") == ""), F.lit("")).otherwise(F.col("answer"))
    return unknown.select(
        F.col("id").alias("_id"), F.lit(K.EXPORT_TAG).alias("tag"), F.array(F.col("question")).alias("patterns"),
        F.array(ans).alias("responses"), F.lit("").alias("context_set"))


def with_positions(exported: DataFrame) -> DataFrame:
    """Dense intent positions in id order (ids are already dense from 1)."""
    return exported.select((F.col("_id") - 1).cast("int").alias("intent_pos"), "tag", "patterns",
                           "responses", "context_set")


def append_question_log(questions: DataFrame, path: str, col: str = "Question") -> None:
    """Append every question at the end of the log (creates it when
    missing); duplicates are kept."""
    questions.select(F.col(col).cast("string").alias("Question")).write.mode("append").parquet(path)


def read_question_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QUESTION_LOG).parquet(path)
