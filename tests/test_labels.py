"""A model's own label table, kept and decoded across changes of the knowledge base."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from askbase.operators import answer as A, labels as L
from askbase.operators.knowledge import KnowledgeBase, flatten_intents
from askbase.operators.routing import TRAIN, WEB
from askbase.session import scratch_path

SCHEMA = "intent_pos int, tag string, patterns array<string>, responses array<string>, context_set string"
BEFORE = [(0, "greeting", ["merhaba", "selam"], ["Merhaba!"], ""), (1, "library", ["kütüphane", "kitap"], ["Açık."], ""),
          (2, " dorm ", ["yurt"], ["Ekimde."], "")]
AFTER = [(0, "exam", ["sınav"], ["Ocakta."], ""), (1, "greeting", ["merhaba", "selam"], ["Merhaba!"], ""),
         (2, "library", ["kütüphane", "kitap"], ["Açık."], "")]


def kb_of(spark, rows):
    return KnowledgeBase(spark.createDataFrame(rows, SCHEMA), persist=False)


def by_id(labels):
    return {r["label_id"]: (r["tag"], r["label"], r["since"]) for r in labels.collect()}


def test_ids_are_never_given_anew(spark):
    first = L.extend_labels(None, kb_of(spark, BEFORE).qa)
    assert by_id(first) == {0: ("greeting", "greeting", 1), 1: ("library", "library", 1), 2: (" dorm ", "dorm", 1)}
    later = L.extend_labels(first, kb_of(spark, AFTER + [(3, "dorm", ["yurt"], ["x"], "")]).qa)
    assert by_id(later) == {**by_id(first), 3: ("exam", "exam", 2), 4: ("dorm", "dorm", 2)}
    inverse = {r["label"]: r["label2id"] for r in later.collect()}
    assert inverse["dorm"] == 4 and {r["num_labels"] for r in later.collect()} == {5}
    assert by_id(L.extend_labels(later, kb_of(spark, BEFORE).qa)) == by_id(later)
    assert by_id(L.extend_labels(first.limit(0), kb_of(spark, BEFORE).qa)).keys() == {0, 1, 2}


def test_a_drifted_knowledge_base_answers_by_the_models_table(spark):
    trained = L.extend_labels(None, kb_of(spark, BEFORE).qa)
    q = spark.createDataFrame([(i, t, dt.datetime(2024, 1, 1)) for i, t in enumerate(["merhaba", "kitap", "yurt", "?"])],
                              "question_id long, text string, as_of timestamp_ntz")
    predict = L.decoded(lambda df: df.withColumn("pred_id", F.col("question_id").cast("int")), trained)
    rows = {r["question_id"]: r for r in A.answer_questions(q, kb_of(spark, AFTER), TRAIN, predict=predict).collect()}
    assert [rows[i]["tag"] for i in range(4)] == ["greeting", "library", "dorm", "unseen_tag"]
    assert rows[0]["answer"] == "Merhaba!" and rows[1]["answer"] == "Açık."
    assert [rows[i]["reason"] for i in range(4)] == [None, None, "unknown_tag", "unknown_tag"]


def test_versions_of_a_model_keep_their_labels(spark):
    store = L.ModelStore(spark, scratch_path(spark, "t-models"))
    with pytest.raises(FileNotFoundError):
        store.load()
    old, _ = L.retrain(store, kb_of(spark, BEFORE), test_fraction=0.0, max_iter=30, width=1 << 10)
    new, _ = L.retrain(store, kb_of(spark, AFTER), test_fraction=0.0, max_iter=30, width=1 << 10)
    assert (old.version, new.version) == (1, 2) and by_id(store.load(1).labels) == by_id(old.labels)
    assert by_id(new.labels)[3] == ("exam", "exam", 2)
    asked = spark.createDataFrame([(1, "kitap"), (2, "merhaba")], "question_id long, text string")
    for model in (store.load(1), store.load(2), store.load()):
        assert {r["question_id"]: r["pred_tag"] for r in model.predict(asked).collect()} == {1: "library", 2: "greeting"}
    said = {r["pred_tag"] for r in new.predict(spark.createDataFrame([(1, "sınav")], "question_id long, text string")).collect()}
    assert said == {"exam"}
    answer = A.answer_questions(asked, kb_of(spark, AFTER), WEB, predict=old.predict).collect()
    assert {r["answer"] for r in answer} == {"Merhaba!", "Açık."}


def test_extended_table_has_every_tag(spark):
    qa = flatten_intents(spark.createDataFrame(AFTER, SCHEMA))
    labels = L.extend_labels(L.extend_labels(None, kb_of(spark, BEFORE).qa), qa)
    assert qa.join(labels, qa["Tag"] == labels["tag"], "left_anti").count() == 0
