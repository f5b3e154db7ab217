"""Refusals: no made-up class, no silent data loss, no half-read requests."""

import pytest
from pyspark.sql import functions as F

from askbase.operators import answer as A
from askbase.operators.routing import WEB
from askbase.plans import fixtures as X
from askbase.operators.knowledge import KnowledgeBase
from askbase.operators.labels import decoded
from askbase.sources.envelopes import parse_requests


def test_answers_need_a_classifier(spark, sf):
    kb = KnowledgeBase(X.kb_intents(spark, sf))
    with pytest.raises(TypeError, match="predict"):
        A.answer_questions(X.questions(spark, sf), kb, WEB)


def test_classifier_sees_gate_passed_texts_only(spark, sf):
    kb = KnowledgeBase(X.kb_intents(spark, sf))
    first = kb.labels.filter("label_id = 0").first()["label"]

    def predict(df):
        return df.withColumn("pred_id", F.when(F.length("text") > 0, 0).otherwise(1 << 20).cast("int"))

    out = A.answer_questions(X.questions(spark, sf), kb, WEB, predict=decoded(predict, kb.labels), carry=("text",)).collect()
    assert any(r["gate_passed"] for r in out) and any(not r["gate_passed"] for r in out)
    assert all((r["tag"] is not None) == bool(r["gate_passed"]) for r in out)
    assert {r["tag"] for r in out if r["gate_passed"]} == {first}
    assert all(r["text"] for r in out)


def test_requests_that_are_no_single_object_with_a_string(spark):
    bodies = {'{"question": "a"}': ("a", None), '{}': ("", None), '{"question": null}': (None, "null question"),
              '{"question": 5}': (None, "question is not a string"), '{"question": true}': (None, "question is not a string"),
              '{"question": {"a":1}}': (None, "question is not a string"), '{"question": "a"} xyz': (None, "malformed request"),
              '{"question": "a"}] x': (None, "malformed request"), '{"question": "a"},{}': (None, "malformed request"),
              '{"question": ': (None, "malformed request"), '5': (None, "malformed request"),
              ' {"question": "5"} ': ("5", None)}
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert {r["body"]: (r["question"], r["error"]) for r in parse_requests(df).collect()} == bodies
