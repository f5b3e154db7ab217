"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (through the fixture adapters in
``fixtures.py``) and runs its operator over all of their rows.  Outputs are
scalar columns (arrays are joined or exploded) so both engines compare
value by value.  Queries that write (round trips, logs) use fresh paths
under the shared checkpoint folder.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from askbase import constants as K
from askbase.functions import calendar as D
from askbase.functions import markup as H
from askbase.functions import text as TX
from askbase.functions.stemming import stem_tokens
from askbase.operators import answer as A
from askbase.operators import chat as C
from askbase.operators import classify as CL
from askbase.operators import count_model as CM
from askbase.operators import encode as EN
from askbase.operators import evaluate as EV
from askbase.operators import gate as G
from askbase.operators import knowledge as KN
from askbase.operators import labels as L
from askbase.operators import routing as R
from askbase.operators import rules as RT
from askbase.operators import training as TR
from askbase.operators import unknowns as U
from askbase.operators.menu import daily_menu
from askbase.plans import fixtures as X
from askbase.session import read_table, scratch_path
from askbase.sources import envelopes as EVL
from askbase.sources import intents as SI
from askbase.sources import unknown_store as US

Query = Callable[[SparkSession, str], DataFrame]
_REG: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        _REG[name] = fn
        return fn
    return deco


def queries() -> dict[str, Query]:
    from askbase.streaming import queries as _stream  # noqa: F401  (registers G6-G8)
    return dict(_REG)


def _intents_scalar(df: DataFrame) -> DataFrame:
    return df.select("intent_pos", "tag", F.array_join("patterns", "|").alias("patterns"),
                     F.array_join("responses", "|").alias("responses"), "context_set")


def _qa(spark, sf) -> DataFrame:
    return KN.flatten_intents(X.kb_intents(spark, sf))


def _kb(spark, sf) -> KN.KnowledgeBase:
    return KN.KnowledgeBase(X.kb_intents(spark, sf))


def _answers(spark, sf, questions: DataFrame, profile=R.WEB, carry=()) -> DataFrame:
    kb = _kb(spark, sf)
    return A.answer_questions(questions, kb, profile, predict=X.fixture_predict(kb.labels), menus=X.menus(spark, sf),
                              carry=carry)


def _msg_questions(msgs: DataFrame) -> DataFrame:
    extra = [c for c in msgs.columns if c not in ("event_id", "text", "ts")]
    return msgs.select(F.col("event_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.col("ts").alias("as_of"), *extra)


# ------------------------------------------------------------------ sources

@register("read_intents")
def q_read_intents(spark, sf):
    path = scratch_path(spark, "intents-lines")
    SI.write_intents(X.kb_intents(spark, sf), path, "lines")
    return _intents_scalar(SI.read_intents(spark, path, "lines"))


@register("read_intents_document")
def q_read_intents_document(spark, sf):
    path = scratch_path(spark, "intents-doc")
    SI.write_intents(X.kb_intents(spark, sf), path, "documents")
    return _intents_scalar(SI.read_intents(spark, path, "documents"))


@register("read_intents_files")
def q_read_intents_files(spark, sf):
    """S1 / S6 in the reference's form: indented documents without positions."""
    path = scratch_path(spark, "intents-files")
    SI.write_intents(X.kb_intents(spark, sf), path, "document")
    return _intents_scalar(SI.read_intents(spark, path, "document"))


@register("read_intents_split")
def q_read_intents_split(spark, sf):
    """S1 for documents of any size: read by lines, split over tasks."""
    path = scratch_path(spark, "intents-files")
    SI.write_intents(X.kb_intents(spark, sf), path, "document")
    return _intents_scalar(SI.read_intents(spark, path, "split"))


@register("read_qa_array")
def q_read_qa_array(spark, sf):
    """S2 / S3 in the reference's form: indented arrays of records."""
    path = scratch_path(spark, "qa-arrays")
    SI.write_qa_records(_qa(spark, sf), path, "array")
    r = SI.read_qa_records(spark, path, "array")
    return r.select("Pattern", "Tag", "Response", "record_pos")


@register("write_qa_records")
def q_write_qa_records(spark, sf):
    path = scratch_path(spark, "qa-records")
    SI.write_qa_records(_qa(spark, sf), path)
    raw = spark.read.text(path)
    return raw.select(F.from_json("value", SI.QA_RECORD_SCHEMA).alias("r")).select("r.*")


@register("read_qa_records")
def q_read_qa_records(spark, sf):
    path = scratch_path(spark, "qa-records")
    SI.write_qa_records(_qa(spark, sf), path)
    return SI.read_qa_records(spark, path)


@register("scan_unknown")
def q_scan_unknown(spark, sf):
    path = scratch_path(spark, "unknown")
    US.write_unknown(X.unknown_table(spark, sf), path)
    return US.scan_unknown(spark, path)


@register("export_intents")
def q_export_intents(spark, sf):
    return _intents_scalar(US.with_positions(US.export_intents(X.unknown_table(spark, sf))))


@register("write_intents")
def q_write_intents(spark, sf):
    path = scratch_path(spark, "export-doc")
    SI.write_intents(US.with_positions(US.export_intents(X.unknown_table(spark, sf))), path, "documents")
    return KN.flatten_intents(SI.read_intents(spark, path, "documents"))


@register("reset_unknown")
def q_reset_unknown(spark, sf):
    """S7 as a service start: a populated table is reset, then the current
    unknown questions are logged; earlier rows are gone, ids restart at 1."""
    from pyspark import StorageLevel
    path = scratch_path(spark, "unknown-reset")
    unknown = X.unknown_questions(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    US.write_unknown(X.unknown_table(spark, sf, unknown), path)
    US.reset_unknown(spark, path)
    batch = unknown.select(F.col("text").alias("question"), F.col("question_id").alias("arrival"))
    U.log_unknown(spark, batch, path)
    unknown.unpersist()
    return US.scan_unknown(spark, path)


@register("empty_qa")
def q_empty_qa(spark, sf):
    """S12 as the seed for accumulation: the knowledge base's flat rows are
    appended onto the empty fixed-column table."""
    seed = SI.empty_qa(spark)
    return KN.append_qa(seed, _qa(spark, sf).select("Pattern", "Tag", "Response"))


@register("append_question_log")
def q_append_question_log(spark, sf):
    path = scratch_path(spark, "question-log")
    qs = X.unknown_questions(spark, sf).select(F.col("text").alias("Question"))
    US.append_question_log(qs, path)
    US.append_question_log(qs, path)
    return US.read_question_log(spark, path)


@register("parse_requests")
def q_parse_requests(spark, sf):
    return EVL.parse_requests(X.requests(spark, sf)).select("event_id", "chat_id", "question", "error")


@register("format_replies")
def q_format_replies(spark, sf):
    ans = _answers(spark, sf, X.questions(spark, sf))
    return EVL.format_replies(ans).select("question_id", "reply")


# ---------------------------------------------------------- reshaping

@register("flatten_intents")
def q_flatten_intents(spark, sf):
    return _qa(spark, sf)


def _kb_patterns_nulled(spark, sf):
    kb = X.kb_intents(spark, sf)
    return kb.withColumn("patterns", F.when(F.col("intent_pos") % 3 == 1, F.lit(None)).otherwise(F.col("patterns")))


@register("flatten_intents_lenient")
def q_flatten_intents_lenient(spark, sf):
    return KN.flatten_intents(_kb_patterns_nulled(spark, sf), lenient=True)


@register("append_qa")
def q_append_qa(spark, sf):
    kb = X.kb_intents(spark, sf)
    first = KN.flatten_intents(kb.filter(F.col("intent_pos") % 2 == 0))
    second = KN.flatten_intents(kb.filter(F.col("intent_pos") % 2 == 1))
    return KN.append_qa(first, second)


@register("preview")
def q_preview(spark, sf):
    return KN.preview(_qa(spark, sf))


@register("pattern_scan")
def q_pattern_scan(spark, sf):
    return KN.pattern_scan(_qa(spark, sf))


# ----------------------------------------------------------- routing

@register("keyword_any")
def q_keyword_any(spark, sf):
    c = X.chat(spark, sf)
    low = F.lower("text")
    return c.select("conv_id", "turn", *[R.keyword_any(low, ph).alias(route) for route, ph in R.WEB.rules])


@register("route_intent")
def q_route_intent(spark, sf):
    return R.route_intent(X.questions(spark, sf), R.WEB).select("question_id", "route")


@register("route_profiles")
def q_route_profiles(spark, sf):
    return R.route_profiles(X.questions(spark, sf)).select("question_id", "profile", "route", "threshold")


@register("route_rules")
def q_route_rules(spark, sf):
    """F1-F3 with a rules table of thousands of phrases: parts of every part name."""
    return RT.route_by_rules(X.questions(spark, sf), X.phrase_rules(spark, sf))


@register("route_rules_built_in")
def q_route_rules_built_in(spark, sf):
    """The reference's own rules as a table give the routes of F3."""
    return RT.route_by_rules(X.questions(spark, sf), RT.built_in_rules(spark)).select("question_id", "profile", "route")


@register("nonempty_input")
def q_nonempty_input(spark, sf):
    return C.nonempty_input(X.blank_turns(X.chat(spark, sf)))


@register("final_only")
def q_final_only(spark, sf):
    return C.final_only(X.utterances(spark, sf)).select("utterance_id", "seq", "text")


@register("final_only_latest")
def q_final_only_latest(spark, sf):
    return C.latest_transcript(X.utterances(spark, sf))


@register("command_match")
def q_command_match(spark, sf):
    return C.command_match(X.messages(spark, sf)).select("event_id", "chat_id", "reply")


# -------------------------------------------------------------- text

@register("casefold_lower")
def q_casefold_lower(spark, sf):
    return X.chat(spark, sf).select("conv_id", "turn", TX.casefold_lower("text").alias("text_lower"))


@register("token_sort_key")
def q_token_sort_key(spark, sf):
    return X.chat(spark, sf).select("conv_id", "turn", TX.token_sort_key("text").alias("sort_key"))


@register("tokenize_clean")
def q_tokenize_clean(spark, sf):
    c = X.chat(spark, sf).withColumn("_t", TX.tokenize_clean("text"))
    return c.select("conv_id", "turn", F.array_join("_t", " ").alias("tokens"), F.size("_t").alias("n_tokens"))


@register("stem_tokens")
def q_stem_tokens(spark, sf):
    c = X.chat(spark, sf).select("conv_id", "turn", TX.tokenize_clean("text").alias("tokens"))
    return stem_tokens(c, ["conv_id", "turn"], "tokens")


@register("strip_text")
def q_strip_text(spark, sf):
    kb = X.kb_intents(spark, sf)
    padded = F.when(F.col("intent_pos") % 2 == 1, F.concat(F.lit(" \t"), "tag", F.lit("\u00a0 "))).otherwise(F.col("tag"))
    return kb.select("intent_pos", padded.alias("raw"), TX.strip_text(padded).alias("stripped"))


@register("utf8_clean")
def q_utf8_clean(spark, sf):
    return X.chat(spark, sf).select("conv_id", "turn", TX.utf8_clean("text").alias("clean"))


def _encoded(spark, sf):
    return EN.encode_pad(X.chat(spark, sf), ["conv_id", "turn"], "text", K.MAX_LEN_TRAIN)


@register("encode_pad")
def q_encode_pad(spark, sf):
    e = _encoded(spark, sf)
    return e.select("conv_id", "turn", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"),
                    F.size("input_ids").alias("padded_len"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"))


@register("encode_pad_serve")
def q_encode_pad_serve(spark, sf):
    """T7 at serving: held-out turns under the vocabulary of the training turns."""
    split = EV.train_test_split(X.chat(spark, sf), _chat_key())
    vocab = EN.vocabulary(split.filter(F.col("split") == "train"))
    e = EN.encode_pad(split.filter(F.col("split") == "test"), ["conv_id", "turn"], "text", K.MAX_LEN_SERVE, vocab)
    return e.select("conv_id", "turn", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"),
                    F.size("input_ids").alias("padded_len"))


@register("zip_examples")
def q_zip_examples(spark, sf):
    chat = X.chat(spark, sf)
    labels = chat.select("conv_id", "turn", X.chat_class().alias("label"))
    z = EN.zip_examples(_encoded(spark, sf), labels, ["conv_id", "turn"])
    return z.select("conv_id", "turn", "labels", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"))


# -------------------------------------------------------- similarity

def _own_pairs(spark, sf):
    part = read_table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), "p_name")
    return X.questions(spark, sf).select("question_id", "text").join(part, "question_id")


@register("token_sort_ratio_indel")
def q_token_sort_ratio_indel(spark, sf):
    return G.pair_scores(_own_pairs(spark, sf), "text", "p_name").select("question_id", "score")


@register("token_sort_ratio_exact")
def q_token_sort_ratio_exact(spark, sf):
    return G.pair_scores(_own_pairs(spark, sf), "text", "p_name", exact=True).select("question_id", "score")


@register("fuzzy_gate")
def q_fuzzy_gate(spark, sf):
    kb = _kb(spark, sf)
    idx = kb.pattern_index()
    q = X.questions(spark, sf)
    outs = [G.fuzzy_gate(q, idx, t).select("question_id", F.lit(t).alias("threshold"),
                                           F.col("gate_passed").alias("passed"))
            for t in (K.THRESHOLD_WEB, K.THRESHOLD_LOCAL)]
    return outs[0].unionByName(outs[1])


@register("fuzzy_gate_many")
def q_fuzzy_gate_many(spark, sf):
    """M3 and M5 over many distinct keys with a pattern side beyond its broadcast budget (1 MB here)."""
    intents, questions = X.many_keys(spark, sf)
    idx = G.build_pattern_index(intents, max_bytes=1 << 20, persist=False)
    passed = G.fuzzy_gate(questions, idx, K.THRESHOLD_WEB).select("question_id", "gate_passed")
    first = G.first_match(questions, idx, K.THRESHOLD_WEB).select("question_id", "pattern", "score")
    return passed.join(first, "question_id", "left")


@register("fuzzy_gate_exact")
def q_fuzzy_gate_exact(spark, sf):
    kb = _kb(spark, sf)
    idx = kb.pattern_index()
    q = X.questions(spark, sf)
    outs = [G.fuzzy_gate(q, idx, t, metric="exact").select("question_id", F.lit(t).alias("threshold"),
                                                          F.col("gate_passed").alias("passed"))
            for t in (K.THRESHOLD_WEB, K.THRESHOLD_LOCAL)]
    return outs[0].unionByName(outs[1])


@register("answer_questions_exact")
def q_answer_questions_exact(spark, sf):
    kb = _kb(spark, sf)
    return A.answer_questions(X.questions(spark, sf), kb, R.WEB, predict=X.fixture_predict(kb.labels),
                              menus=X.menus(spark, sf), metric="exact")


@register("answer_questions_trained")
def q_answer_questions_trained(spark, sf):
    kb = _kb(spark, sf)
    model, _ = L.retrain(L.ModelStore(spark, scratch_path(spark, "models")), kb, max_iter=50)
    return A.answer_questions(X.questions(spark, sf), kb, R.WEB, predict=model.predict, menus=X.menus(spark, sf))


@register("answer_questions_drifted")
def q_answer_questions_drifted(spark, sf):
    """The knowledge base has changed since the model was trained; ids
    keep the meaning of the model's table, tags that are gone are unknown (J1)."""
    trained = _kb(spark, sf)
    return A.answer_questions(X.questions(spark, sf), KN.KnowledgeBase(X.drifted_intents(spark, sf)), R.WEB,
                              predict=X.fixture_predict(trained.labels), menus=X.menus(spark, sf))


@register("extended_labels")
def q_extended_labels(spark, sf):
    """The label table of a model trained anew on the changed knowledge base."""
    return L.extend_labels(L.extend_labels(None, _qa(spark, sf)), KN.flatten_intents(X.drifted_intents(spark, sf)))


@register("candidate_prune")
def q_candidate_prune(spark, sf):
    kb = _kb(spark, sf)
    q = X.questions(spark, sf).select(TX.token_sort_key(F.lower("text")).alias("qkey"))
    pairs = G.candidate_pairs(q, kb.pattern_index(), K.THRESHOLD_WEB)
    return pairs.groupBy("qkey").agg(F.count(F.lit(1)).alias("n_candidates"))


@register("first_match")
def q_first_match(spark, sf):
    kb = _kb(spark, sf)
    return G.first_match(X.questions(spark, sf), kb.pattern_index(), K.THRESHOLD_WEB).select(
        "question_id", "pattern", "score")


# ------------------------------------------------------------ lookups

def _pred_tags(spark, sf, kb):
    p = X.pred(spark, sf).withColumnRenamed("pred", "pred_id")
    return KN.label_decode(p, kb.labels, "pred_id")


@register("tag_known")
def q_tag_known(spark, sf):
    kb = _kb(spark, sf)
    return A.flag_known(_pred_tags(spark, sf, kb), kb.qa).select("vec_id", "pred_tag", "known")


@register("responses_for_tag")
def q_responses_for_tag(spark, sf):
    kb = _kb(spark, sf)
    r = A.responses_for_tag(_pred_tags(spark, sf, kb), kb.qa)
    return r.select("vec_id", "pred_tag", "response", "n_rows")


def _kb_responses_emptied(spark, sf):
    kb = X.kb_intents(spark, sf)
    return kb.withColumn("responses", F.when(F.col("intent_pos") == 2, F.array().cast("array<string>"))
                         .otherwise(F.col("responses")))


@register("no_response")
def q_no_response(spark, sf):
    return KN.tags_without_responses(_kb_responses_emptied(spark, sf))


@register("label_encode_join")
def q_label_encode_join(spark, sf):
    kb = _kb(spark, sf)
    return KN.label_encode(kb.qa, kb.labels)


@register("label_decode")
def q_label_decode(spark, sf):
    kb = _kb(spark, sf)
    v = X.vec(spark, sf).select("vec_id", (CL.argmax("logits") % X.PRED_CLASSES).alias("pred_id"))
    return KN.label_decode(v, kb.labels, "pred_id")


@register("answer_questions")
def q_answer_questions(spark, sf):
    return _answers(spark, sf, X.questions(spark, sf), R.WEB)


@register("answer_questions_ungated")
def q_answer_questions_ungated(spark, sf):
    """J6 without keywords and gate: every text is classified."""
    return _answers(spark, sf, X.questions(spark, sf), R.TRAIN)


@register("answer_questions_local")
def q_answer_questions_local(spark, sf):
    return _answers(spark, sf, X.questions(spark, sf), R.LOCAL)


# -------------------------------------------------------- aggregates

@register("distinct_tags")
def q_distinct_tags(spark, sf):
    return KN.distinct_tags(_qa(spark, sf)).select(
        "tag", F.col("first.intent_pos").alias("first_intent_pos"),
        F.col("first.pattern_pos").alias("first_pattern_pos"), F.col("first.response_pos").alias("first_response_pos"))


@register("label_index")
def q_label_index(spark, sf):
    return KN.label_index(_qa(spark, sf))


@register("accuracy")
def q_accuracy(spark, sf):
    return EV.accuracy(X.pred(spark, sf)).select(F.round("Accuracy", 9).alias("Accuracy"))


@register("macro_prf")
def q_macro_prf(spark, sf):
    m = EV.metrics(X.pred(spark, sf))
    return m.select(*[F.round(c, 9).alias(c) for c in ("Accuracy", "F1", "Precision", "Recall")])


@register("confusion_counts")
def q_confusion_counts(spark, sf):
    return EV.confusion_counts(X.pred(spark, sf))


@register("best_checkpoint")
def q_best_checkpoint(spark, sf):
    return EV.best_checkpoint(X.history(spark, sf))


@register("choose_response")
def q_choose_response(spark, sf):
    kb = _kb(spark, sf)
    r = A.choose_response(_pred_tags(spark, sf, kb), kb, "vec_id", "pred_tag")
    return r.select("vec_id", "pred_tag", "response")


def _chat_key():
    return F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


@register("train_test_split")
def q_train_test_split(spark, sf):
    return EV.train_test_split(X.chat(spark, sf), _chat_key()).select("conv_id", "turn", "split")


@register("train_test_split_scale")
def q_train_test_split_scale(spark, sf):
    return EV.train_test_split(X.chat(spark, sf), _chat_key(), exact=False).select("conv_id", "turn", "split")


@register("split_leakage")
def q_split_leakage(spark, sf):
    qa = _qa(spark, sf)
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in KN.ORDER])
    return EV.split_leakage(EV.train_test_split(qa, key))


@register("chat_latest_first")
def q_chat_latest_first(spark, sf):
    return EV.chat_latest_first(X.chat(spark, sf)).select("conv_id", "turn", "display_pos")


# ------------------------------------------------------ classification

def _chat_labelled(spark, sf):
    c = X.chat(spark, sf)
    return c.withColumn("label", X.chat_class().cast("double"))


def _fit_chat(spark, sf):
    data = EV.train_test_split(_chat_labelled(spark, sf), _chat_key())
    train = data.filter(F.col("split") == "train")
    test = data.filter(F.col("split") == "test")
    return CL.train_classifier(train, "text", "label", max_iter=50, width=1 << 16), test


@register("train_classifier")
def q_train_classifier(spark, sf):
    """Every held-out row with its true class, whether its prediction is one of
    the classes, and whether the model is right more often than the largest class is
    found (what naming that class for every row would give)."""
    model, test = _fit_chat(spark, sf)
    p = CL.predict(model, test).withColumn("label", F.col("label").cast("int"))
    by_class = p.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                      F.sum((F.col("label") == F.col("pred")).cast("bigint")).alias("hits"))
    good = by_class.select(F.sum("hits") > F.max("n")).scalar()
    return p.select("conv_id", "turn", "label", F.col("pred").isin(0, 1, 2).alias("in_label_set"),
                    good.alias("accurate"))


def _count_predictions(spark, sf, reload: bool = False):
    data = EV.train_test_split(_chat_labelled(spark, sf), _chat_key())
    model = CM.fit(data.filter(F.col("split") == "train"))
    if reload:
        path = scratch_path(spark, "count-model")
        model.save(path)
        model = CM.CountModel.load(spark, path)
    test = data.filter(F.col("split") == "test")
    pred = CM.predict(model, test, ["conv_id", "turn"])
    return test.select("conv_id", "turn", F.col("label").cast("int").alias("label")).join(pred, ["conv_id", "turn"])


@register("train_count_model")
def q_train_count_model(spark, sf):
    """C1 with the model of word counts: the class of every held-out turn and its score."""
    return _count_predictions(spark, sf).withColumn("score", F.round("score", 6))


@register("eval_count_model")
def q_eval_count_model(spark, sf):
    """The metrics of that model, saved and loaded again (S11), on the held-out turns."""
    m = EV.metrics(_count_predictions(spark, sf, reload=True))
    return m.select(*[F.round(c, 9).alias(c) for c in ("Accuracy", "F1", "Precision", "Recall")])


@register("train_best_checkpoint")
def q_train_best_checkpoint(spark, sf):
    """C1 in steps: the held-out loss of every evaluation, the step that A6 keeps, and its accuracy."""
    data = EV.train_test_split(_chat_labelled(spark, sf), _chat_key())
    settings = TR.Settings(classes=3, steps=100)
    sides = [TR.examples(data.filter(F.col("split") == s), settings) for s in ("train", "test")]
    saved = TR.train(*sides, scratch_path(spark, "steps"), settings)
    best = EV.best_checkpoint(saved.history()).first()["step"]
    hits = TR.predict(sides[1], saved.load(best)[0]).select(F.avg((F.col("label") == F.col("pred")).cast("double"))).first()[0]
    return saved.history().withColumn("best", F.col("step") == best).withColumn(
        "accuracy", F.when(F.col("best"), F.lit(hits)))


@register("eval_summary")
def q_eval_summary(spark, sf):
    """A7 against the same figures taken from the confusion counts (A5), class by class."""
    model, test = _fit_chat(spark, sf)
    p = CL.predict(model, test).withColumn("label", F.col("label").cast("int")).select("label", "pred")
    path = scratch_path(spark, "held-out")
    p.write.parquet(path)             # both sides read the same predictions
    p = spark.read.parquet(path)
    m = EV.metrics(p)
    cells = EV.confusion_counts(p)
    n, hit = F.col("n"), F.col("label") == F.col("pred")
    by = (cells.select(F.col("label").alias("c"), F.when(hit, n).otherwise(0).alias("tp"), n.alias("true"), F.lit(0).alias("said"))
          .unionByName(cells.select(F.col("pred").alias("c"), F.lit(0).alias("tp"), F.lit(0).alias("true"), n.alias("said")))
          .groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("true").alias("true"), F.sum("said").alias("said")))
    pr = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    rc = F.when(F.col("true") > 0, F.col("tp") / F.col("true")).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("said") + F.col("true"))).otherwise(0.0)
    own = by.agg((F.sum("tp") / F.sum("true")).alias("a"), F.avg(f1).alias("f"), F.avg(pr).alias("p"), F.avg(rc).alias("r"),
                 F.sum("true").cast("bigint").alias("n_rows"),
                 F.sum((F.col("true") > 0).cast("bigint")).alias("n_classes"))

    def same(name, col):
        return (F.abs(m.select(name).scalar() - F.col(col)) < 1e-9).alias(f"same_{name.lower()}")
    return own.select("n_rows", "n_classes", same("Accuracy", "a"), same("F1", "f"), same("Precision", "p"), same("Recall", "r"))


@register("save_load_model")
def q_save_load_model(spark, sf):
    model, test = _fit_chat(spark, sf)
    labels = X.chat(spark, sf).select(X.chat_class().alias("label_id"), F.col("role").alias("tag"),
                                      F.col("role").alias("label")).distinct()
    store = L.ModelStore(spark, scratch_path(spark, "model"))
    store.save(model, labels)
    again = store.load()
    # both models score the same row side by side; nothing is joined back
    both = CL.predict(model, test).withColumnRenamed("pred", "pred_saved").drop("probs")
    both = again.predict(both)
    return both.select("conv_id", "turn", (F.col("pred_saved") == F.col("pred_id")).alias("same"),
                       (F.col("pred_tag") != "unseen_tag").alias("named"))


@register("softmax_scores")
def q_softmax_scores(spark, sf):
    p = CL.softmax(X.vec(spark, sf), "logits")
    return p.select("vec_id", F.posexplode("probs").alias("class_id", "prob")).select(
        "vec_id", "class_id", F.round("prob", 9).alias("prob"))


@register("argmax_label")
def q_argmax_label(spark, sf):
    return X.vec(spark, sf).select("vec_id", CL.argmax("logits").alias("pred_id"))


@register("score_batch")
def q_score_batch(spark, sf):
    v = X.vec(spark, sf)
    e = read_table(spark, sf, "embeddings").select("vec_id", "label", F.transform(
        "embedding", lambda x: x.cast("double")).alias("logits"))
    s = CL.linear_scores(v, ["vec_id"], "logits", CL.centroid_weights(e, "logits", "label"))
    return s.select("vec_id", CL.argmax("scores").alias("pred_id"), F.round(F.array_max("scores"), 6).alias("best_score"))


# --------------------------------------------------------------- dates

def _ev(spark, sf):
    return read_table(spark, sf, "events").select("event_id", "ts")


@register("tr_month_name")
def q_tr_month_name(spark, sf):
    return _ev(spark, sf).select("event_id", D.month_name_tr(F.month("ts")).alias("month_name"))


@register("tr_day_name")
def q_tr_day_name(spark, sf):
    day = F.when(F.col("event_id") % 7 == 0, F.lit("Funday")).otherwise(D.english_day_name("ts"))
    return _ev(spark, sf).select("event_id", D.day_name_tr(day).alias("day_name"))


@register("today_sentence")
def q_today_sentence(spark, sf):
    return _ev(spark, sf).select("event_id", D.today_sentence("ts").alias("sentence"))


@register("weekday_sentence")
def q_weekday_sentence(spark, sf):
    return _ev(spark, sf).select("event_id", D.weekday_sentence("ts").alias("sentence"))


@register("tomorrow_sentence")
def q_tomorrow_sentence(spark, sf):
    return _ev(spark, sf).select("event_id", D.tomorrow_sentence("ts").alias("sentence"))


@register("time_string")
def q_time_string(spark, sf):
    return _ev(spark, sf).select("event_id", D.time_string("ts").alias("time"))


# ---------------------------------------------------------------- html

def _explode_cells(df: DataFrame, col: str) -> DataFrame:
    rows = df.select("page_id", F.posexplode(col).alias("row_pos", "cells"))
    return rows.select("page_id", "row_pos", F.posexplode("cells").alias("cell_pos", "cell"))


def _menu_box(spark, sf):
    return X.menu_pages(spark, sf).select("page_id", H.html_container("html", *K.MENU_CONTAINER).alias("box"))


def _menu_rows(spark, sf):
    return _menu_box(spark, sf).select("page_id", H.html_rows_cells("box").alias("rows"))


@register("html_container")
def q_html_container(spark, sf):
    return _menu_box(spark, sf)


@register("html_rows_cells")
def q_html_rows_cells(spark, sf):
    return _explode_cells(_menu_rows(spark, sf), "rows")


@register("trim_header_footer")
def q_trim_header_footer(spark, sf):
    p = _menu_rows(spark, sf)
    return _explode_cells(p.withColumn("kept", H.trim_header_footer("rows")), "kept")


@register("menu_text")
def q_menu_text(spark, sf):
    p = _menu_rows(spark, sf).withColumn("kept", H.trim_header_footer("rows"))
    return p.select("page_id", H.menu_text("kept").alias("menu"))


@register("daily_menu")
def q_daily_menu(spark, sf):
    return daily_menu(X.menu_pages(spark, sf)).select("page_id", "menu")


# -------------------------------------------------------------- unknowns

@register("log_unknown")
def q_log_unknown(spark, sf):
    path = scratch_path(spark, "unknown-log")
    q = X.questions(spark, sf).select(F.col("text").alias("question"), F.col("question_id").alias("arrival"))
    n = q.select(F.max("arrival")).first()[0]
    half = (n or 0) // 2
    U.log_unknown(spark, q.filter(F.col("arrival") <= half), path)
    U.log_unknown(spark, q.filter(F.col("arrival") > half), path)
    return US.scan_unknown(spark, path)


@register("unknown_sites")
def q_unknown_sites(spark, sf):
    return U.unknown_sites(_answers(spark, sf, X.questions(spark, sf)))


@register("fallback_answer")
def q_fallback_answer(spark, sf):
    return U.fallback_answers(_answers(spark, sf, X.questions(spark, sf)))


@register("merge_answered")
def q_merge_answered(spark, sf):
    return U.merge_answered(X.kb_intents(spark, sf), X.unknown_table(spark, sf))


# ---------------------------------------------------------------- chat

def _request_answers(spark, sf):
    req = EVL.parse_requests_once(X.requests(spark, sf))
    carry = ("chat_id", "ts", "question", "error")
    ok = req.filter(F.col("error").isNull()).select(
        F.col("event_id").alias("question_id"), F.col("question").alias("text"), F.col("ts").alias("as_of"), *carry)
    ans = _answers(spark, sf, ok, carry=carry).select(F.col("question_id").alias("event_id"), *carry, "answer")
    failed = req.filter(F.col("error").isNotNull()).select("event_id", *carry, F.lit(None).cast("string").alias("answer"))
    return ans.unionByName(failed)


@register("append_turns")
def q_append_turns(spark, sf):
    return C.append_turns(_request_answers(spark, sf))


@register("role_flag")
def q_role_flag(spark, sf):
    return C.role_flag(X.chat(spark, sf)).select("conv_id", "turn", "is_user", "speakable")


@register("error_reply")
def q_error_reply(spark, sf):
    return C.error_reply(_request_answers(spark, sf)).select("event_id", "chat_id", "reply")


def _message_answers(spark, sf, msgs=None):
    msgs = msgs if msgs is not None else X.messages(spark, sf)
    q = _msg_questions(msgs)
    kb = _kb(spark, sf)
    ans = A.answer_questions(q, kb, R.WEB, predict=X.fixture_predict(kb.labels), menus=X.menus(spark, sf),
                             carry=("chat_id",))
    return ans.select(F.col("question_id").alias("event_id"), "chat_id", "answer", "is_unknown")


@register("message_fanout")
def q_message_fanout(spark, sf):
    msgs = X.messages(spark, sf)
    return C.message_fanout(msgs, _message_answers(spark, sf, msgs))


@register("missing_text")
def q_missing_text(spark, sf):
    msgs = X.messages(spark, sf).filter(F.col("text").isNull())
    m = C.missing_text(msgs)
    ans = _answers(spark, sf, _msg_questions(m), carry=("text",))
    return ans.select(F.col("question_id").alias("event_id"), F.col("text").alias("question"), "answer", "is_unknown")
