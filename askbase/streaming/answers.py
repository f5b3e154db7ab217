"""Streams of chat messages.

The answer flow is one streaming plan: every message is routed, gated row by row
against the broadcast pattern keys, classified and joined to static lookup
tables (``answer_rows``), with no aggregation, no state and no ``foreachBatch``; messages are
dealt over all cores first.  Append
sinks are Spark's file sink, whose own log makes a replayed micro-batch count once.

Where a stream needs more than that:

* ``stream_unknown`` keeps the questions of a time span as state and stores new
  ones in the keyed unknown table, which is idempotent;
* ``stream_fanout`` writes several sinks per micro-batch and publishes them with one
  manifest, numbered by the batch: a replayed batch finds its number taken;
* ``stream_transcripts`` keeps the latest text per utterance.

A knowledge base over the gate's broadcast budget has no pattern array; its messages
are answered per micro-batch by the batch plan, in a folder per batch id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from askbase import constants as K
from askbase.operators import answer as A
from askbase.operators import chat as C
from askbase.operators import gate as G
from askbase.operators import knowledge as KN
from askbase.operators import routing as R
from askbase.operators import unknowns as U
from askbase.operators.menu import MenuTable
from askbase.sources.commit_log import CommitLog
from askbase.sources.envelopes import parse_requests_once

Predict = Callable[[DataFrame], DataFrame]

#: Time for which a stream remembers a question or an utterance.
REMEMBER = "1 day"


@dataclass
class Answering:
    """The static side of the answer flow, prepared and sized once before a stream starts."""

    kb: KN.KnowledgeBase
    predict: Predict
    menus: MenuTable | None = None
    profile: R.Profile = R.WEB
    packed: DataFrame | None = None

    @classmethod
    def of(cls, kb, predict: Predict, menus: DataFrame | None = None, profile: R.Profile = R.WEB) -> Answering:
        index = kb.pattern_index()
        packed = G.pack_index(index) if index.broadcast and profile.threshold is not None else None
        return cls(kb, predict, None if menus is None else MenuTable(menus), profile, packed)

    @property
    def by_row(self) -> bool:
        return self.packed is not None or self.profile.threshold is None

    def __call__(self, messages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """``event_id, chat_id, ts, question, answer, is_unknown`` and ``carry`` of messages with ``text``."""
        q = messages.select(F.col("event_id").alias("question_id"), "chat_id", F.col("ts").alias("as_of"),
                            F.coalesce("text", F.lit("")).alias("text"), *carry)
        keep = ("chat_id", "as_of", "text", *carry)
        if self.by_row:
            if messages.isStreaming:      # a file or topic partition may hold a whole micro-batch
                q = q.repartition(messages.sparkSession.sparkContext.defaultParallelism)
            ans = A.answer_rows(q, self.kb, self.profile, self.predict, self.menus, carry=keep, packed=self.packed)
        else:
            ans = A.answer_questions(q, self.kb, self.profile, self.predict, self.menus, carry=keep)
        return ans.select(F.col("question_id").alias("event_id"), "chat_id", F.col("as_of").alias("ts"),
                          F.col("text").alias("question"), "answer", "is_unknown", *carry)


def _run(writer, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _append(stream: DataFrame, answering: Answering, shape: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
            available_now: bool) -> StreamingQuery:
    """``shape`` of the answers, appended to ``sink`` once per message."""
    if answering.by_row:
        w = shape(answering(stream)).writeStream.format("parquet").option("path", sink)
        return _run(w.option("checkpointLocation", checkpoint), available_now)

    def handle(batch: DataFrame, batch_id: int):
        shape(answering(batch)).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return _run(stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint), available_now)


def stream_answers(stream: DataFrame, answering: Answering, sink: str, checkpoint: str,
                   available_now: bool = True) -> StreamingQuery:
    """Every message answered independently."""
    return _append(stream, answering, lambda a: a, sink, checkpoint, available_now)


def _turns(answers: DataFrame) -> DataFrame:
    pair = F.array(F.struct(F.lit(0).alias("i"), F.lit("user").alias("role"), F.col("question").alias("text")),
                   F.struct(F.lit(1).alias("i"), F.lit("bot").alias("role"), F.col("answer").alias("text")))
    return answers.select("chat_id", "ts", "event_id", F.explode(pair).alias("m")).select(
        "chat_id", "ts", "event_id", "m.i", "m.role", "m.text")


def stream_turns(stream: DataFrame, answering: Answering, sink: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Each answered message appends (user, bot) rows keyed by chat and
    event time; turn numbers are assigned when the log is read (no state)."""
    return _append(stream, answering, _turns, sink, checkpoint, available_now)


def read_turns(spark: SparkSession, sink: str) -> DataFrame:
    """The turn log with R4-style numbering per chat, in event order."""
    from askbase.operators.indexing import group_rank
    rows = spark.read.parquet(sink)
    r = group_rank(rows, ["chat_id"], [F.col("ts"), F.col("event_id"), F.col("i")], "turn")
    return r.select("chat_id", "turn", "role", "text")


def _milliseconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def first_seen(unknown: DataFrame, remember: str = REMEMBER) -> DataFrame:
    """``question, arrival`` of a stream, at most once per question and ``remember``.

    State: a row per question seen within ``remember`` of event time, then dropped.
    Rows that come later than ``remember`` behind the latest event are not looked at.
    """
    keep = _milliseconds(remember)

    def note(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        arrival, last = None, 0
        for p in parts:
            low = int(p["arrival"].min())
            arrival = low if arrival is None else min(arrival, low)
            last = max(last, int(p["at"].max().timestamp() * 1000))
        new = not state.exists
        state.update((1,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep)
        if new:
            yield pd.DataFrame({"question": [key[0]], "arrival": [arrival]})

    timed = unknown.select("question", F.col("event_id").alias("arrival"), F.col("ts").cast("timestamp").alias("at"))
    return timed.withWatermark("at", remember).groupBy("question").applyInPandasWithState(
        note, "question string, arrival bigint", "seen int", "append", GroupStateTimeout.EventTimeTimeout)


def stream_unknown(stream: DataFrame, answering: Answering, table: str, checkpoint: str, remember: str = REMEMBER,
                   available_now: bool = True) -> StreamingQuery:
    """U1 across the life of the stream.

    ``first_seen`` lets a question through once per time span, so a micro-batch asks
    the keyed table only for questions that are new to the stream, and reads only their
    buckets; the table decides, so forgetting a question or replaying a batch adds nothing.
    """
    def store(batch: DataFrame, batch_id: int):
        U.log_unknown(batch.sparkSession, batch, table)

    def answer_and_store(batch: DataFrame, batch_id: int):
        rows = answering(batch).filter("is_unknown").select("question", F.col("event_id").alias("arrival"))
        U.log_unknown(batch.sparkSession, rows, table)

    if not answering.by_row:
        w = stream.writeStream.foreachBatch(answer_and_store)
    else:
        w = first_seen(answering(stream).filter("is_unknown"), remember).writeStream.foreachBatch(store)
    return _run(w.option("checkpointLocation", checkpoint), available_now)


#: Sinks of ``stream_fanout``.
ECHO, ANSWER, ERROR = "echo", "answer", "error"


def fan_out(requests: DataFrame, answering: Answering) -> DataFrame:
    """G3 and G4 for request bodies: ``event_id, chat_id, ts, kind, question, reply, is_unknown``.

    A body that is no request gives one ``error`` row with the fixed message; a
    question gives an ``answer`` row and, if it holds an echo command, an ``echo`` row too.
    """
    read = parse_requests_once(requests).withColumn("text", F.col("question"))
    good = answering(read.filter(F.col("error").isNull()))
    cols = ["event_id", "chat_id", "ts", "kind", "question", "reply", "is_unknown"]
    answers = good.withColumn("kind", F.lit(ANSWER)).withColumn("reply", F.col("answer"))
    echo = C.command_match(read.filter(F.col("error").isNull())).withColumn("kind", F.lit(ECHO)).withColumn(
        "is_unknown", F.lit(False))
    bad = C.error_reply(read.filter(F.col("error").isNotNull()).withColumn("answer", F.lit(None).cast("string")))
    bad = bad.withColumn("kind", F.lit(ERROR)).withColumn("is_unknown", F.lit(False))
    return answers.select(*cols).unionByName(echo.select(*cols)).unionByName(bad.select(*cols))


def stream_fanout(stream: DataFrame, answering: Answering, sink: str, unknown: str, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    """G3 and G4 on a stream of bodies: echo, answer and error sinks and the unknown table.

    A micro-batch is written to a folder of its own, partitioned by sink, and becomes
    visible in all sinks at once by its manifest.  One checkpoint per sink folder.
    """
    log = CommitLog(stream.sparkSession, sink)

    def handle(batch: DataFrame, batch_id: int):
        if log.published(batch_id + 1):
            return
        folder = uuid.uuid4().hex
        path = f"{log.path}/data/{folder}"
        rows = fan_out(batch, answering)
        rows.write.partitionBy("kind").parquet(path)
        written = batch.sparkSession.read.schema(rows.schema).parquet(path)
        U.log_unknown(batch.sparkSession, written.filter("is_unknown").select("question", F.col("event_id").alias("arrival")), unknown)
        log.publish(batch_id + 1, {"folder": folder})

    return _run(stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint), available_now)


def read_sink(spark: SparkSession, sink: str, kind: str | None = None) -> DataFrame:
    """The published rows of ``stream_fanout``, of one sink or of all."""
    log = CommitLog(spark, sink)
    schema = "event_id bigint, chat_id bigint, ts timestamp_ntz, question string, reply string, is_unknown boolean, kind string"
    folders = [f"{log.path}/data/{log.read(v)['folder']}" for v in log.versions()]
    if not folders:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(f) for f in folders]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows if kind is None else rows.filter(F.col("kind") == kind)


def latest_transcripts(utterances: DataFrame, remember: str = REMEMBER) -> DataFrame:
    """F5 on a stream: ``utterance_id, seq, text`` whenever a later partial or final replaces
    the text of an utterance, by sequence number and not by time of arrival.

    State: a row per utterance heard within ``remember`` of event time.  The last
    row of an utterance, by ``seq``, is what ``chat.latest_transcript`` gives.
    """
    keep = _milliseconds(remember)

    def newest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get[0] if state.exists else None
        best, text, last = known, None, 0
        for p in parts:
            last = max(last, int(p["at"].max().timestamp() * 1000))
            i = p["seq"].idxmax()
            if best is None or p["seq"][i] > best:
                best, text = int(p["seq"][i]), p["text"][i]
        state.update((best,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep)
        if best != known:
            yield pd.DataFrame({"utterance_id": [key[0]], "seq": [best], "text": [text]})

    timed = utterances.select("utterance_id", "seq", "text", F.col("ts").cast("timestamp").alias("at"))
    return timed.withWatermark("at", remember).groupBy("utterance_id").applyInPandasWithState(
        newest, "utterance_id bigint, seq bigint, text string", "seq bigint", "append", GroupStateTimeout.EventTimeTimeout)


def stream_transcripts(stream: DataFrame, sink: str, checkpoint: str, remember: str = REMEMBER,
                       available_now: bool = True) -> StreamingQuery:
    """the texts of ``latest_transcripts`` appended to ``sink``; read it with ``chat.latest_transcript``."""
    w = latest_transcripts(stream, remember).writeStream.format("parquet").option("path", sink)
    return _run(w.option("checkpointLocation", checkpoint), available_now)
