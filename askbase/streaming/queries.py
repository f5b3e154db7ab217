"""Registered streaming queries: run to completion with ``availableNow`` and
return the sink read back as a batch DataFrame."""

from __future__ import annotations

from askbase.operators import chat as C
from askbase.operators import knowledge as KN
from askbase.plans import fixtures as X
from askbase.plans.registry import register
from askbase.session import scratch_path
from askbase.sources.unknown_store import scan_unknown
from askbase.streaming import answers as S


def _setup(spark, sf):
    kb = KN.KnowledgeBase(X.kb_intents(spark, sf))
    return S.Answering.of(kb, X.fixture_predict(kb.labels), X.menus(spark, sf))


def _paths(spark, name):
    return scratch_path(spark, name), scratch_path(spark, f"{name}-ckpt")


@register("stream_answers")
def q_stream_answers(spark, sf):
    answering = _setup(spark, sf)
    sink, ckpt = _paths(spark, "stream-answers")
    S.stream_answers(X.message_stream(spark, sf), answering, sink, ckpt).awaitTermination()
    answering.kb.close()
    return spark.read.parquet(sink).select("event_id", "chat_id", "answer")


@register("stream_unknown")
def q_stream_unknown(spark, sf):
    answering = _setup(spark, sf)
    table, ckpt = _paths(spark, "stream-unknown")
    S.stream_unknown(X.message_stream(spark, sf), answering, table, ckpt).awaitTermination()
    answering.kb.close()
    return scan_unknown(spark, table)


@register("stream_turns")
def q_stream_turns(spark, sf):
    answering = _setup(spark, sf)
    sink, ckpt = _paths(spark, "stream-turns")
    S.stream_turns(X.message_stream(spark, sf), answering, sink, ckpt).awaitTermination()
    answering.kb.close()
    return S.read_turns(spark, sink).select("chat_id", "turn", "role", "text")


@register("stream_fanout")
def q_stream_fanout(spark, sf):
    """G3 and G4 as a stream: all sinks of the request bodies."""
    answering = _setup(spark, sf)
    sink, ckpt = _paths(spark, "stream-fanout")
    bodies = X.as_bodies(X.event_stream(spark, sf, pathGlobFilter="events.parquet"))
    S.stream_fanout(bodies, answering, sink, scratch_path(spark, "stream-fanout-unknown"), ckpt).awaitTermination()
    answering.kb.close()
    return S.read_sink(spark, sink).select("event_id", "chat_id", "kind", "reply", "is_unknown")


@register("stream_transcripts")
def q_stream_transcripts(spark, sf):
    """F5 as a stream: the text that the partial results of each utterance leave."""
    sink, ckpt = _paths(spark, "stream-transcripts")
    S.stream_transcripts(X.as_utterances(X.event_stream(spark, sf, pathGlobFilter="events.parquet")), sink, ckpt).awaitTermination()
    return C.latest_transcript(spark.read.parquet(sink))
