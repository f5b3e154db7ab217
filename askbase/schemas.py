"""Explicit schemas: nothing is inferred at read time."""

from pyspark.sql import types as T

INTENT = T.StructType([
    T.StructField("tag", T.StringType()),
    T.StructField("patterns", T.ArrayType(T.StringType())),
    T.StructField("responses", T.ArrayType(T.StringType())),
    T.StructField("context_set", T.StringType()),
])

# One JSON object per line holding one intent (the scalable layout).
INTENT_LINE = INTENT

# The single-document layout {"intents": [...]}.
INTENTS_DOC = T.StructType([T.StructField("intents", T.ArrayType(INTENT))])

QA = T.StructType([
    T.StructField("Pattern", T.StringType()),
    T.StructField("Tag", T.StringType()),
    T.StructField("Response", T.StringType()),
])

QA_POS = T.StructType(QA.fields + [
    T.StructField("intent_pos", T.IntegerType()),
    T.StructField("pattern_pos", T.IntegerType()),
    T.StructField("response_pos", T.IntegerType()),
])

UNKNOWN = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("question", T.StringType(), False),
    T.StructField("answer", T.StringType(), True),
])

QUESTION_LOG = T.StructType([T.StructField("Question", T.StringType())])

METRICS = T.StructType([
    T.StructField("Accuracy", T.DoubleType()),
    T.StructField("F1", T.DoubleType()),
    T.StructField("Precision", T.DoubleType()),
    T.StructField("Recall", T.DoubleType()),
])

MESSAGE = T.StructType([
    T.StructField("chat_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("text", T.StringType()),
])
