"""Streams equal their batch twins for any cut into micro-batches, and keep bounded state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from askbase.operators import answer as A, chat as C, gate as G
from askbase.operators.knowledge import KnowledgeBase
from askbase.operators.routing import LOCAL, TRAIN, WEB
from askbase.plans import fixtures as X
from askbase.session import scratch_path
from askbase.sources.unknown_store import scan_unknown
from askbase.streaming import answers as S


@pytest.fixture(scope="module")
def answering(spark, sf):
    kb = KnowledgeBase(X.kb_intents(spark, sf))
    return S.Answering.of(kb, X.fixture_predict(kb.labels), X.menus(spark, sf))


def cut(spark, sf, at):
    """The events as one file per part, to be read one a micro-batch."""
    src, ev = scratch_path(spark, "t-events"), spark.read.parquet(f"{sf}/events.parquet")
    for i, (lo, hi) in enumerate(zip([0, *at], [*at, 10 ** 9])):
        ev.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.parquet(f"{src}/part{i}")
    return lambda: X.event_stream(spark, src, maxFilesPerTrigger=1, recursiveFileLookup="true")


def batch_answers(spark, sf, answering):
    m = X.messages(spark, sf).select(F.col("event_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("text"),
                                     F.col("ts").alias("as_of"))
    return A.answer_questions(m, answering.kb, WEB, predict=answering.predict, menus=answering.menus, carry=("text",))


def test_row_flow_equals_key_flow(spark, sf, answering):
    q = X.questions(spark, sf).unionByName(spark.createDataFrame(
        [(10 ** 6 + i, t, dt.datetime(2024, 1, 1)) for i, t in enumerate(["", "?", None, "x" * 300, "ü"])],
        "question_id long, text string, as_of timestamp_ntz"))
    for profile in (WEB, LOCAL, TRAIN):
        a = A.answer_questions(q, answering.kb, profile, answering.predict, answering.menus)
        b = A.answer_rows(q, answering.kb, profile, answering.predict, answering.menus)
        assert sorted(a.collect(), key=repr) == sorted(b.collect(), key=repr)
    with pytest.raises(ValueError, match="broadcastBytes"):
        G.pack_index(G.size_index(answering.kb.pattern_index().df, max_bytes=10))


def test_answer_stream_is_one_streaming_plan_and_survives_a_restart(spark, sf, answering):
    source = cut(spark, sf, [300, 650])
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    plan = answering(X.as_messages(source()))
    assert plan.isStreaming
    text = plan._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" not in text.split("StreamingRelation")[0].split("Join")[0]
    first = X.as_messages(source())
    q = S.stream_answers(first, answering, sink, ckpt, available_now=False)   # runs until stopped, somewhere in the middle
    import time
    for _ in range(600):
        if q.lastProgress is not None and q.lastProgress["batchId"] >= 0:
            break
        time.sleep(0.1)
    q.stop()
    S.stream_answers(X.as_messages(source()), answering, sink, ckpt).awaitTermination()
    got = sorted((r["event_id"], r["answer"]) for r in spark.read.parquet(sink).collect())
    want = sorted((r["question_id"], r["answer"]) for r in batch_answers(spark, sf, answering).collect())
    assert got == want


@pytest.mark.parametrize("at", [[], [300, 650], [10, 20, 30, 500]])
def test_stream_unknown_equals_batch_for_any_cut(spark, sf, answering, at):
    table = scratch_path(spark, "t-unknown")
    q = S.stream_unknown(X.as_messages(cut(spark, sf, at)()), answering, table, scratch_path(spark, "t-ckpt"), remember="3650 days")
    q.awaitTermination()
    first = batch_answers(spark, sf, answering).filter("is_unknown").groupBy("text").agg(F.min("question_id").alias("a")).collect()
    want = [(i + 1, t) for i, (_, t) in enumerate(sorted((r["a"], r["text"]) for r in first))]
    assert sorted((r["id"], r["question"]) for r in scan_unknown(spark, table).collect()) == want


def minutes(spark, rows):
    """(question, event_id, minute) rows as a one-file folder."""
    path = scratch_path(spark, "t-rows")
    base = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(q, i, base + dt.timedelta(minutes=m)) for q, i, m in rows],
                          "question string, event_id long, ts timestamp_ntz").coalesce(1).write.parquet(path)
    return path


def test_state_is_bounded_and_late_rows_are_left_out(spark):
    src = scratch_path(spark, "t-src")
    parts = [[(f"q{b}-{i}", 100 * b + i, 60 * b + i % 50) for i in range(40)] + [("same", 100 * b + 50, 60 * b)] for b in range(8)]
    parts.append([("late", 990, 0), ("q7-1", 991, 430)])
    for b, rows in enumerate(parts):
        spark.read.parquet(minutes(spark, rows)).coalesce(1).write.parquet(f"{src}/{b:02d}")
    stream = (spark.readStream.schema("question string, event_id long, ts timestamp_ntz").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(src))
    seen = []

    def keep(batch, batch_id):
        seen.extend((batch_id, r["question"], r["arrival"]) for r in batch.collect())

    q = (S.first_seen(stream, "2 hours").writeStream.foreachBatch(keep)
         .option("checkpointLocation", scratch_path(spark, "t-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(totals) <= 5 * 41 and sum(len(p) for p in parts) > 300       # of the last hours only
    names = [t for _, t, _ in seen]
    assert "late" not in names and names.count("q7-1") == 1
    assert all(a % 100 == 50 or a < 100 * 8 for _, _, a in seen)
    assert {t for t in names if t != "same"} == {t for p in parts[:8] for t, _, _ in p} - {"same"}
    assert names.count("same") == 1          # heard every hour, so it is never forgotten


def test_fanout_publishes_all_sinks_at_once_and_replays_change_nothing(spark, sf, answering, monkeypatch):
    source = cut(spark, sf, [400])
    sink, table = scratch_path(spark, "t-fan"), scratch_path(spark, "t-fan-unknown")
    ckpt = scratch_path(spark, "t-ckpt")
    failing = {"left": 1}
    plain = S.CommitLog.publish

    def publish(self, version, manifest):
        if failing["left"] and "folder" in manifest and version == 2:
            failing["left"] -= 1
            raise RuntimeError("driver lost before the batch was published")
        return plain(self, version, manifest)

    monkeypatch.setattr(S.CommitLog, "publish", publish)
    with pytest.raises(Exception):
        S.stream_fanout(X.as_bodies(source()), answering, sink, table, ckpt).awaitTermination()
    assert S.read_sink(spark, sink).agg(F.max("event_id")).first()[0] < 400        # nothing of the second batch in any sink
    S.stream_fanout(X.as_bodies(source()), answering, sink, table, ckpt).awaitTermination()
    rows = S.read_sink(spark, sink).collect()
    # the whole stream again, as if the checkpoint had been lost: every batch is published already
    S.stream_fanout(X.as_bodies(source()), answering, sink, table, scratch_path(spark, "t-ckpt")).awaitTermination()
    assert sorted(S.read_sink(spark, sink).collect(), key=repr) == sorted(rows, key=repr)
    bodies = X.as_bodies(spark.read.parquet(f"{sf}/events.parquet"))
    want = S.fan_out(bodies, answering)
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in rows))) == sorted(map(repr, map(tuple, want.collect())))
    assert {r["event_id"] for r in rows if r["kind"] == "error"} == {r["event_id"] for r in bodies.collect() if r["event_id"] % 10 >= 8}
    unknown = [r["question"] for r in scan_unknown(spark, table).collect()]
    assert len(unknown) == len(set(unknown)) and set(unknown) == {r["question"] for r in rows if r["is_unknown"]}


@pytest.mark.parametrize("at", [[], [100, 101, 800]])
def test_latest_transcripts_for_any_cut(spark, sf, at):
    sink = scratch_path(spark, "t-latest")
    S.stream_transcripts(X.as_utterances(cut(spark, sf, at)()), sink, scratch_path(spark, "t-ckpt"), "1 hour").awaitTermination()
    got = sorted(tuple(r) for r in C.latest_transcript(spark.read.parquet(sink)).collect())
    assert got == sorted(tuple(r) for r in C.latest_transcript(X.utterances(spark, sf)).collect())


def test_the_row_gate_meets_patterns_as_blocks(spark, sf, answering):
    """A message does not carry the pattern array through the plan: its distinct keys are tested as a block."""
    plan = answering(X.as_messages(cut(spark, sf, [500])()))._jdf.queryExecution().analyzed().toString()
    assert "_patterns" not in plan and "lambda p" not in plan and "passes(" in plan


def test_bodies_are_read_once(spark, sf, answering):
    """`append_turns`, `error_reply`, `stream_fanout`: no reading of JSON is left in what follows the parser."""
    from askbase.plans.registry import queries
    rows = S.fan_out(X.as_bodies(X.read_table(spark, sf, "events")), answering)
    for df in (rows, queries()["append_turns"](spark, sf), queries()["error_reply"](spark, sf)):
        assert "json" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_menu_pages_are_read_by_many_tasks(spark, sf):
    """`stream_unknown`, `stream_turns`: the pages of a file with one row group do not meet in one task."""
    from askbase.operators.menu import daily_menu
    menus = X.menus(spark, sf)
    assert X.read_table(spark, sf, "pages").rdd.getNumPartitions() < 4 <= menus.rdd.getNumPartitions()
    plain = daily_menu(X.menu_pages(spark, sf)).select(F.expr(X.MENU_DATE_SQL).alias("menu_date"), "menu")
    assert sorted(menus.collect(), key=repr) == sorted(plain.collect(), key=repr)
