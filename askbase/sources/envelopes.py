"""Request / reply envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from askbase.session import scratch_path


def parse_requests(requests: DataFrame, body_col: str = "body") -> DataFrame:
    """``{"question": ...}`` -> ``question`` plus ``error``.

    A missing key gives ''.  A JSON null, a value that is no string, malformed
    JSON and text behind the object give an error row instead of failing the
    job (the reference fails on them).
    """
    # one let-bound value: the checks stay out of the expressions that use the question
    read = F.transform(F.array(body_col), _read_body)[0]
    return requests.withColumn("question", read["question"]).withColumn("error", read["error"])


def parse_requests_once(requests: DataFrame, body_col: str = "body") -> DataFrame:
    """S9, written to the shared scratch folder: the optimizer copies the reading of a body into
    every later use of ``question`` and ``error``, such as each phrase of the routing rules."""
    spark, out = requests.sparkSession, parse_requests(requests, body_col)
    path = scratch_path(spark, "requests")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _read_body(body: Column) -> Column:
    keys = F.json_object_keys(body)          # null for malformed JSON
    # the parsers stop at the end of a value: as the only element of an array, and from brace to brace
    listed = F.concat(F.lit("["), body, F.lit("]"))
    alone = (F.json_array_length(listed) == 1) & body.rlike(r"^\s*\{[\s\S]*\}\s*$")
    broken = keys.isNull() | F.coalesce(~alone, F.lit(True))
    parsed = F.get_json_object(body, "$.question")
    # a list keeps its elements as JSON text, where only a string has quotes
    is_string = F.get_json_object(listed, "$[*].question").startswith('"')
    has_key = F.array_contains(keys, "question")
    error = (F.when(broken, F.lit("malformed request"))
             .when(has_key & parsed.isNull(), F.lit("null question"))
             .when(has_key & ~is_string, F.lit("question is not a string")))
    question = F.when(error.isNull(), F.when(has_key, parsed).otherwise(""))
    return F.struct(question.alias("question"), error.alias("error"))


def format_replies(df: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Answer -> ``{"answer": ...}`` JSON text."""
    return df.withColumn("reply", F.to_json(F.struct(F.col(answer_col).alias("answer"))))
