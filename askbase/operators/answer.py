"""Response lookup and the whole decision.

``answer_questions`` composes routing (F2), the fuzzy gate (M3), a class
prediction, label decoding (J5), the known-tag test (J1), the repeatable
response choice (R1) and the fallback (U3) into one lazy plan.  All lookups
go against tables bounded by the knowledge base (tags, response rows) or by
the calendar (one menu per day): they are broadcast after a size check.
The question side is shuffled only by the gate: the distinct keys (after a
map-side combine) and, when the verdict table is too large to broadcast,
the join of the verdicts back on the key.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from askbase import constants as K
from askbase.functions import calendar as D
from askbase.functions.text import strip_text, utf8_clean
from askbase.operators import gate as G
from askbase.operators.indexing import group_rank
from askbase.operators.knowledge import ORDER, KnowledgeBase
from askbase.operators.menu import MenuTable
from askbase.operators.sizing import sized_broadcast
from askbase.operators.routing import WEB, Profile, route_expr

# Join keys that the routed rows are dealt over.
ROUTED_KEYS = 65_536


def md5_bucket(*parts) -> Column:
    """Non-negative bigint from the first 32 bits of md5(parts joined by ':')."""
    s = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def tag_response_table(qa: DataFrame, strip_tags: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tag -> n_rows) and (tag, ordinal) -> response, ordinals in document
    order, so R1 draws uniformly over rows (duplicates count).  The tag is
    the raw one (the reference compares raw tags) unless ``strip_tags``."""
    tag = strip_text("Tag") if strip_tags else F.col("Tag")
    t = qa.select(tag.alias("tag"), F.col("Response").alias("response"), *ORDER)
    counts = t.groupBy("tag").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = group_rank(t, ["tag"], [F.col(c) for c in ORDER], "ord").select("tag", "ord", "response")
    return counts, rows


def _tags(qa, tag_col: str) -> DataFrame:
    if isinstance(qa, KnowledgeBase):
        qa = qa.qa
    return qa.select(F.col("Tag").alias(tag_col)).distinct()


def tag_known(preds: DataFrame, qa: DataFrame, tag_col: str = "pred_tag") -> DataFrame:
    """Predictions whose tag exists in the knowledge base (exact equality)."""
    return preds.join(sized_broadcast(_tags(qa, tag_col)), tag_col, "left_semi")


def tag_unknown(preds: DataFrame, qa: DataFrame, tag_col: str = "pred_tag") -> DataFrame:
    """J1 complement: predictions that fall back."""
    return preds.join(sized_broadcast(_tags(qa, tag_col)), tag_col, "left_anti")


def flag_known(preds: DataFrame, qa: DataFrame, tag_col: str = "pred_tag") -> DataFrame:
    """J1 as a column ``known``: every prediction stays, one join."""
    tags = _tags(qa, tag_col).withColumn("known", F.lit(True))
    return preds.join(sized_broadcast(tags), tag_col, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def responses_for_tag(preds: DataFrame, qa: DataFrame, tag_col: str = "pred_tag") -> DataFrame:
    """The responses of the predicted tag, each once with the number of its
    rows in ``n_rows`` (patterns x responses repeat a text many times, so they
    are counted before the join)."""
    if isinstance(qa, KnowledgeBase):
        qa = qa.qa
    r = qa.groupBy(F.col("Tag").alias(tag_col), F.col("Response").alias("response")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    return preds.join(sized_broadcast(r), tag_col, "inner")


def choose_response(preds: DataFrame, qa, key_col: str = "question_id",
                    tag_col: str = "pred_tag", seed: str = "42", strip_tags: bool = False) -> DataFrame:
    """One response per row, uniform over the tag's response rows, chosen
    by md5(seed:key) so retries and replays agree.  Adds ``n_rows`` (null =
    tag unknown) and ``response``.  ``qa``: a flat QA table or a
    ``KnowledgeBase`` (whose response table is built once and reused)."""
    if isinstance(qa, KnowledgeBase):
        counts, rows = qa.response_table(strip_tags)
    else:
        counts, rows = (sized_broadcast(t) for t in tag_response_table(qa, strip_tags))
    out = preds.join(counts.withColumnRenamed("tag", tag_col), tag_col, "left")
    out = out.withColumn("_ord", F.when(F.col("n_rows") > 0,
                                        F.pmod(md5_bucket(F.lit(seed), F.col(key_col)), F.col("n_rows"))))
    rows = rows.withColumnRenamed("tag", tag_col).withColumnRenamed("ord", "_ord")
    return out.join(rows, [tag_col, "_ord"], "left").drop("_ord")


def answer_questions(questions: DataFrame, kb, profile: Profile = WEB,
                     predict: Callable[[DataFrame], DataFrame] | None = None,
                     menus: DataFrame | MenuTable | None = None, choice_seed: str = "42",
                     index: G.PatternIndex | None = None, strip_tags: bool = False,
                     carry: tuple[str, ...] = (), metric: str = "indel") -> DataFrame:
    """The whole decision per question.

    ``questions``: ``question_id, text[, as_of]`` (without ``as_of`` the
    query's current local time is used); ``kb``: a ``KnowledgeBase``
    or an intents table.  ``menus``: ``menu_date,
    menu`` (one row per day).  Output: ``question_id, route, gate_passed,
    tag, answer, is_unknown, reason``.  A tag stored with surrounding blanks
    never matches its (stripped) predicted label, as in the reference;
    ``strip_tags=True`` compares stripped tags instead.  ``carry`` names
    input columns passed through to the output (no join back needed).
    ``predict`` adds ``pred_tag``, the class decoded by the *model's* label table
    (``labels.TrainedModel.predict`` or ``labels.decoded``), to a table with
    ``question_id`` and ``text``; whether the knowledge base has that tag is asked
    here.  Rows that were routed or stopped by the gate come with an empty text.
    ``metric``: ``indel`` (native M1, the default) or ``exact`` (the
    reference's Ratcliff-Obershelp ratio on the pairs M1 lets through).
    """
    if not isinstance(kb, KnowledgeBase):
        kb = KnowledgeBase(kb)
    q = _routed(questions, profile, predict)
    if profile.threshold is not None:
        if index is None:
            index = kb.pattern_index()
        # a routed row gets one of many keys that no pattern has (keys hold no blank
        # at an end): its verdict is not asked for, and all of them together are no hot key
        apart = F.concat(F.lit(" "), F.pmod(F.xxhash64("question_id"), F.lit(ROUTED_KEYS)).cast("string"))
        q = q.withColumn("qkey", F.when(F.col("route").isNull(), G.token_sort_key(F.lower("text"))).otherwise(apart))
        passed = G.passing_keys(q.filter(F.col("route").isNull()), index, profile.threshold,
                                metric=metric)
        q = (q.join(passed.withColumn("gate_passed", F.lit(True)), "qkey", "left")
             .withColumn("gate_passed", F.when(F.col("route").isNull(),
                                               F.coalesce("gate_passed", F.lit(False)))))
    else:
        q = q.withColumn("gate_passed", F.when(F.col("route").isNull(), F.lit(True)))
    return _decided(q, kb, predict, menus, choice_seed, strip_tags, carry)


def answer_rows(questions: DataFrame, kb: KnowledgeBase, profile: Profile = WEB,
                predict: Callable[[DataFrame], DataFrame] | None = None, menus: DataFrame | MenuTable | None = None,
                choice_seed: str = "42", strip_tags: bool = False, carry: tuple[str, ...] = (),
                packed: DataFrame | None = None) -> DataFrame:
    """J6 row by row: no aggregation, no shuffle and no state, so ``questions`` may be a
    stream (with ``as_of``).  All other sides are static tables within the broadcast budget."""
    q = _routed(questions, profile, predict)
    ask = F.col("route").isNull()
    if profile.threshold is not None:
        q = G.row_gate(q, G.pack_index(kb.pattern_index()) if packed is None else packed, profile.threshold, ask)
    else:
        q = q.withColumn("gate_passed", F.when(ask, F.lit(True)))
    return _decided(q, kb, predict, menus, choice_seed, strip_tags, carry)


def _routed(questions: DataFrame, profile: Profile, predict) -> DataFrame:
    if predict is None:
        raise TypeError("answer_questions needs predict: a function that adds pred_tag, for example "
                        "TrainedModel.predict of operators.labels")
    if "as_of" not in questions.columns:
        # the reference reads the wall clock; one instant per query keeps
        # the answers of a run consistent (pass ``as_of`` to make them repeatable)
        questions = questions.withColumn("as_of", F.localtimestamp())
    q = questions.withColumn("text", F.coalesce("text", F.lit("")))  # G5: missing text = ''
    return q.withColumn("route", route_expr(F.lower("text"), profile))


def _decided(q: DataFrame, kb: KnowledgeBase, predict, menus, choice_seed: str, strip_tags: bool,
             carry: tuple[str, ...]) -> DataFrame:
    """Routed and gated questions to answers: classify, J1, R1, menus, U2, U3."""
    # classes are asked for after the gate only: other rows reach the classifier without words
    q = q.withColumn("_text", F.col("text")).withColumn("text", F.when(F.col("gate_passed"), F.col("text")).otherwise(""))
    q = predict(q).withColumn("text", F.col("_text")).drop("_text")
    q = q.withColumn("pred_tag", F.when(F.col("gate_passed"), F.col("pred_tag")))
    q = choose_response(q, kb, "question_id", "pred_tag", choice_seed, strip_tags)

    if menus is not None:
        menus = menus if isinstance(menus, MenuTable) else MenuTable(menus)
        m = menus.df.select(F.col("menu_date").alias("_d"), F.col("menu").alias("_menu"))
        q = q.join(m, F.to_date("as_of") == F.col("_d"), "left")
        menu_answer = F.coalesce(F.col("_menu"), F.lit(K.MENU_UNAVAILABLE))
    else:
        menu_answer = F.lit(K.MENU_UNAVAILABLE)

    reason = (F.when(F.col("route").isNotNull(), F.lit(None))
              .when(~F.col("gate_passed"), F.lit("no_match"))
              .when(F.col("n_rows").isNull(), F.lit("unknown_tag"))
              .when(F.col("n_rows") == 0, F.lit("no_response")))
    answer = (F.when(F.col("route") == K.ROUTE_MEAL, menu_answer)
              .when(F.col("route") == K.ROUTE_DATE, D.today_sentence("as_of"))
              .when(F.col("route") == K.ROUTE_TIME, D.time_string("as_of"))
              .when(F.col("route") == K.ROUTE_WEEKDAY, D.weekday_sentence("as_of"))
              .when(F.col("route") == K.ROUTE_TOMORROW, D.tomorrow_sentence("as_of"))
              .when(F.col("reason").isNotNull(), F.lit(K.FALLBACK_ANSWER))
              .otherwise(utf8_clean("response")))
    q = q.withColumn("reason", reason)
    return q.select("question_id", *carry, "route", "gate_passed", F.col("pred_tag").alias("tag"),
                    answer.alias("answer"), F.col("reason").isNotNull().alias("is_unknown"), "reason")


def answer_one(spark, kb, text: str | None, as_of=None, profile: Profile = WEB, question_id: int = 0,
               **kw) -> str:
    """One question in, one answer out (the reference's ``predict(text)``),
    through the same plan as ``answer_questions``.  For interactive use; batch
    and stream callers pass tables."""
    rows = [(question_id, text, as_of)] if as_of is not None else [(question_id, text)]
    schema = ("question_id long, text string, as_of timestamp_ntz" if as_of is not None
              else "question_id long, text string")
    q = spark.createDataFrame(rows, schema)
    return answer_questions(q, kb, profile, **kw).select("answer").first()["answer"]
