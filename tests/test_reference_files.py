"""The reference's own file forms: one indented document or array per file."""

import json

import pytest

from askbase.session import scratch_path
from askbase.sources import intents as SI


def _file(tmp_path, text):
    p = tmp_path / "f.json"
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_indented_array_of_records(spark, tmp_path):
    recs = [{"Pattern": "selam", "Tag": "t", "Response": "ş"}, {"Pattern": "b", "Tag": "t", "Response": None}]
    path = _file(tmp_path, json.dumps(recs, indent=4, ensure_ascii=False))
    rows = SI.read_qa_records(spark, path, "array").orderBy("record_pos").collect()
    assert [{k: r[k] for k in ("Pattern", "Tag", "Response")} for r in rows] == recs
    with pytest.raises(Exception, match="no QA record"):      # read as lines it must not become null rows
        SI.read_qa_records(spark, path).collect()
    with pytest.raises(Exception, match="no array of QA records"):
        SI.read_qa_records(spark, _file(tmp_path, "oops"), "array").collect()


def test_single_document(spark, tmp_path):
    doc = {"intents": [{"tag": f"t{i}", "patterns": ["p", "ğ"], "responses": ["r"], "context_set": ""} for i in range(3)]}
    path = _file(tmp_path, json.dumps(doc, indent=2, ensure_ascii=False))
    rows = sorted(SI.read_intents(spark, path, "document").collect())
    assert [(r.intent_pos, r.tag, r.patterns) for r in rows] == [(i, f"t{i}", ["p", "ğ"]) for i in range(3)]
    with pytest.raises(Exception, match="no intents document"):
        SI.read_intents(spark, _file(tmp_path, "[1, 2]"), "document").collect()


def test_documents_in_chunks_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(SI, "CHUNK_INTENTS", 4)
    df = spark.createDataFrame([(i, f"t{i}", ["p"], ["r"], "") for i in range(11)], SI.LINE_SCHEMA)
    path = scratch_path(spark, "t-files")
    SI.write_intents(df, path, "document")
    back = SI.read_intents(spark, path, "document").collect()
    assert sorted((r.intent_pos, r.tag) for r in back) == [(i, f"t{i}") for i in range(11)]


def _documents():
    plain = {"intents": [{"tag": f"t{i} \\\" {{[", "patterns": ["p]}", "ğ\n\t", "x" * (i * 7)], "responses": ["r\\"], "context_set": ""}
                         for i in range(60)]}
    other = {"version": "1", "other": [{"tag": "no", "patterns": [{"a": [1]}]}], "meta": {"intents": "no", "k": [1, [2]]},
             "intents": plain["intents"][:3], "last": [{"tag": "no"}]}
    return plain, other


@pytest.mark.parametrize("form", [dict(indent=2), dict(indent=4, separators=(" ,", " : ")), dict(), dict(indent=0)])
def test_a_split_document_equals_the_whole_one(spark, tmp_path, form):
    for k, doc in enumerate(_documents()):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, ensure_ascii=False, **form), encoding="utf-8")
    (tmp_path / "2.json").write_text('{"intents": []}')
    want = sorted(SI.read_intents(spark, str(tmp_path), "document").collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert sorted(SI.read_intents(spark, str(tmp_path), "split").collect()) == want and len(want) == 63
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_a_split_document_that_is_none_fails(spark, tmp_path):
    for text in ("[1, 2]", '{"intents": [{"tag": "a"}', '{"other": []}', "oops"):
        with pytest.raises(Exception, match="no intents document"):
            SI.read_intents(spark, _file(tmp_path, text), "split").collect()
