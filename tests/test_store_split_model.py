"""Unknown store, exports, split properties, classifier, stemmer, streaming."""

import json
import os

from pyspark.sql import functions as F

from askbase import schemas
from askbase.functions.stemming import stem, stem_tokens
from askbase.operators import classify as CL
from askbase.operators import evaluate as EV
from askbase.operators import knowledge as KN
from askbase.operators import unknowns as U
from askbase.session import scratch_path
from askbase.sources import intents as SI
from askbase.sources import unknown_store as US
from tests.porter_twin import porter_stem


def test_reset_and_empty_tables(spark):
    path = scratch_path(spark, "t-reset")
    t = US.reset_unknown(spark, path)
    assert t.count() == 0 and [f.name for f in t.schema.fields] == ["id", "question", "answer"]
    e = SI.empty_qa(spark)
    assert e.count() == 0 and e.columns == ["Pattern", "Tag", "Response"]


def test_log_unknown_idempotent_dense(spark):
    path = scratch_path(spark, "t-unknown")
    batch1 = spark.createDataFrame([("Fener şampiyon olucak mı", 1), ("a", 2), ("a", 3), (None, 4), ("A", 5)],
                                   "question string, arrival long")
    U.log_unknown(spark, batch1, path)
    U.log_unknown(spark, batch1, path)                     # replay adds nothing
    batch2 = spark.createDataFrame([("b", 6), ("a", 7)], "question string, arrival long")
    U.log_unknown(spark, batch2, path)
    rows = sorted((r.id, r.question, r.answer) for r in US.scan_unknown(spark, path).collect())
    assert rows == [(1, "Fener şampiyon olucak mı", None), (2, "a", None), (3, "A", None), (4, "b", None)]


def test_export_matches_sample_document(spark):
    unk = spark.createDataFrame([(1, "fener şampiyon olucak mı", None), (2, "fenerbahçe şampiyon olacak mı", "")],
                                schemas.UNKNOWN)
    path = scratch_path(spark, "t-export")
    SI.write_intents(US.with_positions(US.export_intents(unk)), path, "document")
    files = [f for f in os.listdir(path.replace("file:", "")) if f.endswith(".txt")]
    doc = json.loads(open(os.path.join(path.replace("file:", ""), files[0]), encoding="utf-8").read())
    assert doc == {"intents": [
        {"tag": "custom_tag", "patterns": ["fener şampiyon olucak mı"], "responses": [""], "context_set": ""},
        {"tag": "custom_tag", "patterns": ["fenerbahçe şampiyon olacak mı"], "responses": [""], "context_set": ""}]}
    back = SI.read_intents(spark, path, "document").orderBy("intent_pos").collect()
    assert [r.patterns[0] for r in back] == ["fener şampiyon olucak mı", "fenerbahçe şampiyon olacak mı"]


def test_split_disjoint_complete_exact(spark):
    df = spark.range(1001).withColumnRenamed("id", "k")
    s = EV.train_test_split(df, F.col("k").cast("string"))
    n_test = s.filter("split = 'test'").count()
    assert n_test == 251 and s.count() == 1001 and s.select("k").distinct().count() == 1001


def test_macro_prf_known_values(spark):
    # labels/preds where sklearn's macro scores are known by hand
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)]
    m = EV.metrics(spark.createDataFrame(rows, "label int, pred int")).first()
    # classes 0,1,2: P = (1/2, 2/3, 0), R = (1/2, 1, 0), F1 = (1/2, 4/5, 0)
    assert abs(m.Precision - (0.5 + 2 / 3) / 3) < 1e-12
    assert abs(m.Recall - 0.5) < 1e-12
    assert abs(m.F1 - (0.5 + 0.8) / 3) < 1e-12
    assert abs(m.Accuracy - 0.6) < 1e-12


def test_classifier_separable_and_reload(spark):
    rows = [(f"merhaba selam {i}", 0.0) for i in range(40)] + [(f"kütüphane saatleri {i}", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "text string, label double")
    model = CL.train_classifier(df, max_iter=30)
    p = CL.predict(model, df)
    acc = p.select(F.avg((F.col("pred") == F.col("label").cast("int")).cast("double"))).first()[0]
    assert acc >= 0.95
    path = scratch_path(spark, "t-model")
    CL.save_model(model, path)
    again = CL.predict(CL.load_model(path), df)
    assert sorted(r.pred for r in p.collect()) == sorted(r.pred for r in again.collect())


def test_porter_published_examples(spark):
    cases = {"caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
             "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
             "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
             "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
             "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
             "generalizations": "gener", "oscillators": "oscil"}
    df = spark.createDataFrame([(w,) for w in cases], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", stem("w").alias("s")).collect()} == cases
    assert {w: porter_stem(w) for w in cases} == cases


def test_stems_equal_the_plain_algorithm(spark, sf):
    import random
    from askbase.functions.stemming import STEP2, STEP3, STEP4
    rnd = random.Random(1)
    ends = [s for s, _ in STEP2 + STEP3] + STEP4 + ["s", "sses", "ies", "ss", "eed", "ed", "ing", "y", "e", "ll", "ied", "yed", "é", ""]
    words = {"".join(rnd.choices("abcdeiouylstz", k=rnd.randrange(0, 7))) + rnd.choice(ends) + rnd.choice(["", "", "s", "ed"]) for _ in range(8000)}
    words |= {"yy", "yyy", "syzygy", "a", "", "by", "şehirler", "123s", "x\U0001F600ing"}
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(8)
    got = {r["w"]: r["s"] for r in df.select("w", stem("w").alias("s")).collect()}
    assert got == {w: porter_stem(w) for w in words}
    rows = spark.createDataFrame([(1, ["running", "flies", "the", "running"]), (2, []), (3, None), (4, ["b"])], "id int, t array<string>")
    assert {r["id"]: r["stemmed"] for r in stem_tokens(rows, ["id"], "t").collect()} == {1: "run fli the run", 2: "", 3: None, 4: "b"}


def test_stream_equals_batch(spark, sf):
    from askbase.plans.registry import queries
    q = queries()
    stream = {(r.event_id, r.answer) for r in q["stream_answers"](spark, sf).collect()}
    from askbase.plans import fixtures as X
    from askbase.operators import answer as A
    from askbase.operators.routing import WEB
    msgs = X.messages(spark, sf)
    qs = msgs.select(F.col("event_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("text"),
                     F.col("ts").alias("as_of"))
    kb = KN.KnowledgeBase(X.kb_intents(spark, sf))
    batch = {(r.question_id, r.answer) for r in
             A.answer_questions(qs, kb, WEB, predict=X.fixture_predict(kb.labels), menus=X.menus(spark, sf)).collect()}
    assert stream == batch


def test_documents_layout_keeps_order_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(SI, "CHUNK_INTENTS", 7)
    rows = [(i, f"t{i % 3}", [f"p{i}"], [f"r{i}"], "") for i in range(50)]
    df = spark.createDataFrame(rows, "intent_pos int, tag string, patterns array<string>, "
                                     "responses array<string>, context_set string").repartition(5)
    path = scratch_path(spark, "t-docs")
    SI.write_intents(df, path, "documents")
    back = SI.read_intents(spark, path, "documents").collect()
    assert sorted((r.intent_pos, r.patterns[0]) for r in back) == [(i, f"p{i}") for i in range(50)]


def test_linear_scores_of_a_weight_table(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, []), (4, None)], "id int, x array<double>")
    w = [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]]
    w = spark.createDataFrame([(c, d, x) for c, row in enumerate(w) for d, x in enumerate(row)],
                              "class int, dim int, w double")
    got = {r.id: r.scores for r in CL.linear_scores(df, ["id"], "x", w).collect()}
    assert got == {1: [1.0, 1.5, 2.0], 2: [3.0, 1.0, -1.0], 3: [], 4: []}


def test_encode_with_the_training_vocabulary(spark):
    from askbase.operators import encode as EN
    train = spark.createDataFrame([(1, "a b a"), (2, "a c")], "id int, text string")
    later = spark.createDataFrame([(7, "c a zzz"), (8, ""), (9, None), (10, "b b b b b")], "id int, text string")
    e = EN.encode_pad(later, ["id"], "text", 4, EN.vocabulary(train))
    got = {r.id: (r.input_ids, r.attention_mask) for r in e.collect()}
    assert got == {7: ([3, 1, 4, 0], [1, 1, 1, 0]), 8: ([0] * 4, [0] * 4), 9: ([0] * 4, [0] * 4),
                   10: ([2] * 4, [1] * 4)}


def test_final_only_is_stateless_on_a_stream(spark, sf):
    """F5 applied to a streaming DataFrame equals the batch result."""
    from askbase.operators import chat as CH
    from askbase.plans import fixtures as X
    utt = X.as_utterances(X.event_stream(spark, sf, pathGlobFilter="events.parquet"))
    sink = scratch_path(spark, "t-final-stream")
    q = (CH.final_only(utt).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", scratch_path(spark, "t-final-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(sink).select("utterance_id", "seq", "text").collect())
    want = sorted(tuple(r) for r in CH.final_only(X.utterances(spark, sf)).select("utterance_id", "seq", "text").collect())
    assert got == want and len(got) > 0


def test_document_layout_orders_files_by_name(spark):
    rows = [(i, "t", [f"p{i}"], ["r"], "") for i in range(6)]
    schema = "intent_pos int, tag string, patterns array<string>, responses array<string>, context_set string"
    base = scratch_path(spark, "t-multi-doc")
    SI.write_intents(spark.createDataFrame(rows[:4], schema), base + "/a", "document")
    SI.write_intents(spark.createDataFrame(rows[4:], schema), base + "/b", "document")
    back = SI.read_intents(spark, base + "/*", "document").collect()
    assert sorted((r.intent_pos, r.patterns[0]) for r in back) == [(i, f"p{i}") for i in range(6)]


def test_exact_split_equals_global_rank(spark):
    from pyspark.sql import Window
    df = spark.range(5003).select(F.col("id").cast("string").alias("k"))
    got = {r.k: r.split for r in EV.train_test_split(df, F.col("k")).collect()}
    h = EV._split_hash(F.col("k"), 123)
    ranked = df.withColumn("h", h).withColumn("r", F.row_number().over(Window.orderBy("h", "k")) - 1)
    n_test = -(-5003 // 4)
    want = {r.k: ("test" if r.r < n_test else "train") for r in ranked.collect()}
    assert got == want and sum(v == "test" for v in got.values()) == n_test
