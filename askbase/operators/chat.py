"""Conversations and chat messages (F4-F6, G1-G5, R4 helpers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from askbase import constants as K
from askbase.operators.indexing import group_rank


def nonempty_input(df: DataFrame, text_col: str = "text") -> DataFrame:
    """drop empty submissions (blank-only text passes)."""
    return df.filter(F.col(text_col) != "")


def final_only(utterances: DataFrame) -> DataFrame:
    """keep the final transcripts (stateless, also in a stream)."""
    return utterances.filter(F.col("is_final"))


def latest_transcript(utterances: DataFrame) -> DataFrame:
    """the text a partial-results stream leaves per utterance (last seq)."""
    return utterances.groupBy("utterance_id").agg(F.max_by("text", "seq").alias("text"),
                                                  F.max("seq").alias("seq"))


def command_match(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """messages holding ``/echo X`` anywhere (``.`` stops at a newline);
    the reply is X."""
    # one regex pass: the group is ``.+``, so it is non-empty exactly when the
    # pattern matches (an unmatched or null text gives '' or null)
    return (messages.withColumn("reply", F.regexp_extract(F.col(text_col), K.ECHO_PATTERN, 1))
            .filter(F.col("reply") != ""))


def role_flag(chat: DataFrame) -> DataFrame:
    """User side vs bot side; only bot rows are spoken aloud."""
    return (chat.withColumn("is_user", F.col("role") == "user")
            .withColumn("speakable", F.col("role") == "bot"))


def error_reply(requests: DataFrame, answer_col: str = "answer") -> DataFrame:
    """A failed request gets the fixed error message; one bad row never
    fails the job."""
    return requests.withColumn(
        "reply", F.when(F.col("error").isNotNull(), F.lit(K.BOT_ERROR_MESSAGE)).otherwise(F.col(answer_col)))


def missing_text(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """A message without text reaches the service as ''."""
    return messages.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))


def append_turns(replies: DataFrame, key_col: str = "chat_id", order_cols=("ts", "event_id")) -> DataFrame:
    """G1: each successful reply adds two rows, user then bot; a failure adds
    none.  Turn numbers are 2k and 2k+1 for the k-th success of the chat."""
    ok = replies.filter(F.col("error").isNull())
    ok = group_rank(ok, [key_col], [F.col(c) for c in order_cols], "_k")
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text"), F.lit(0).alias("i")),
                   F.struct(F.lit("bot").alias("role"), F.col("answer").alias("text"), F.lit(1).alias("i")))
    return ok.select(key_col, "_k", F.explode(pair).alias("m")).select(
        key_col, (F.col("_k") * 2 + F.col("m.i")).cast("bigint").alias("turn"),
        F.col("m.role").alias("role"), F.col("m.text").alias("text"))


def message_fanout(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """An ``/echo`` message is handled by both listeners: the echo reply
    and the normal answer (``answers``: event_id, chat_id, answer)."""
    echo = command_match(messages).select("event_id", "chat_id", F.lit("echo").alias("kind"), "reply")
    normal = answers.select("event_id", "chat_id", F.lit("answer").alias("kind"), F.col("answer").alias("reply"))
    return echo.unionByName(normal)
