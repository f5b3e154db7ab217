"""Rules as a table against plain loops; training in steps against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from askbase.operators import evaluate as EV, routing as R, rules as RT, training as TR
from askbase.plans import fixtures as X
from askbase.session import scratch_path


def brute(texts, rules):
    """First phrase by (priority, phrase) that a lower-cased text contains, per profile."""
    out = set()
    for i, t in texts:
        for profile in {r[0] for r in rules}:
            hits = sorted((p, ph, route) for pr, p, route, ph in rules
                          if pr == profile and ph is not None and t is not None and ph in t.lower())
            out.add((i, profile, *((hits[0][2], hits[0][0], hits[0][1]) if hits else (None, None, None))))
    return out


def test_rules_table_equals_a_loop(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choices("abcş ", k=n))
    rules = [(rnd.choice("xy"), rnd.randrange(40), f"r{i}", word(rnd.randrange(1, 7))) for i in range(300)]
    rules += [("x", 90, "null", None), ("z", 1, "never", "qqqq"), ("z", 1, "never", "aqq")]
    texts = [(i, word(rnd.randrange(0, 30)).upper()) for i in range(400)] + [(400, None), (401, ""), (402, "x" * 5000 + "abc")]
    texts += [(500 + i, "the same text abc") for i in range(50)]
    q = spark.createDataFrame(texts, "question_id long, text string").repartition(4)
    got = RT.route_by_rules(q, spark.createDataFrame(rules, RT.RULES)).collect()
    assert {tuple(r) for r in got} == brute(texts, rules) and len(got) == 3 * len(texts)
    empty = rules[:40] + [("y", 1, "all", "")]
    got = RT.route_by_rules(q, spark.createDataFrame(empty, RT.RULES)).collect()
    assert {tuple(r) for r in got} == brute(texts, empty)
    assert RT.route_by_rules(q, spark.createDataFrame([], RT.RULES)).count() == 0
    assert RT.route_by_rules(q.limit(0), spark.createDataFrame(rules, RT.RULES)).count() == 0


def test_built_in_rules_equal_the_compiled_ones(spark, sf):
    q = X.questions(spark, sf)
    table = RT.route_by_rules(q, RT.built_in_rules(spark)).select("question_id", "profile", "route")
    want = R.route_profiles(q).select("question_id", "profile", "route")
    assert sorted(table.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_phrases_meet_texts_in_an_equi_join(spark, sf):
    phrases = X.phrase_rules(spark, sf).select("phrase")
    plan = RT.match_phrases(X.questions(spark, sf).select(F.lower("text").alias("low")), phrases)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "HashJoin" in text


def dense(df, width):
    rows = df.collect()
    x = np.zeros((len(rows), width + 1))
    for r, row in zip(x, rows):
        for i in row["w"]:
            r[i] += 1
        r[:-1] = np.where(r[:-1] > 0, 1 + np.log(np.maximum(r[:-1], 1)), 0)
        r[:-1] /= max(np.linalg.norm(r[:-1]), 1e-300)
        r[-1] = 1
    return x, np.array([r["label"] for r in rows])


def dense_loss(x, y, w):
    s = x @ w.T
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return -np.log(p[np.arange(len(y)), y]).mean(), p


@pytest.fixture(scope="module")
def sides(spark, sf):
    chat = X.chat(spark, sf).withColumn("label", X.chat_class())
    extra = spark.createDataFrame([("u", "", 0), ("u", None, 1), ("u", "x", None), ("u", "x", 7)], "role string, text string, label int")
    chat = chat.select("role", "text", "label").unionByName(extra)
    settings = TR.Settings(classes=3, width=256, steps=100)
    halves = [chat.filter(F.coalesce(F.length("text"), F.lit(0)) % 4 != 1), chat.filter(F.length("text") % 4 == 1)]
    return settings, [TR.examples(h, settings) for h in halves]


def test_steps_equal_numpy(spark, sides):
    settings, (data, held) = sides
    x, y = dense(data, settings.width)
    xh, yh = dense(held, settings.width)
    saved = TR.train(data, held, scratch_path(spark, "t-steps"), settings)
    w, v, losses = np.zeros((3, 257)), np.zeros((3, 257)), {}
    for step in range(1, 101):
        _, p = dense_loss(x, y, w)
        p[np.arange(len(y)), y] -= 1
        v = settings.momentum * v - settings.rate * (p.T @ x / len(y) + settings.decay * w)
        w = w + v
        if step % 50 == 0:
            losses[step] = dense_loss(xh, yh, w)[0]
    got = {r["step"]: r["loss"] for r in saved.history().collect()}
    assert got.keys() == losses.keys() and all(abs(got[s] - losses[s]) < 1e-9 for s in got)
    assert np.abs(saved.load(100)[0] - w).max() < 1e-9
    pred = sorted(tuple(r) for r in TR.predict(held, saved.load(100)[0]).collect())
    assert pred == sorted(zip(yh.tolist(), (xh @ w.T).argmax(axis=1).tolist()))
    assert sum(a == b for a, b in pred) > max(np.bincount(yh))


def test_the_best_step_is_kept_and_a_run_goes_on(spark, sides, monkeypatch):
    settings, (data, held) = sides
    monkeypatch.setattr(TR, "EVAL_STEPS", 5)
    half, whole = (TR.Settings(classes=3, width=256, steps=s) for s in (10, 20))
    path = scratch_path(spark, "t-steps")
    TR.train(data, held, path, half)
    saved = TR.train(data, held, path, whole)                 # as after a lost driver
    straight = TR.train(data, held, scratch_path(spark, "t-steps"), whole)
    assert [s["step"] for s in saved.steps()] == [5, 10, 15, 20]
    assert np.abs(saved.load(20)[0] - straight.load(20)[0]).max() < 1e-9
    assert TR.train(data, held, path, whole).log.latest()[0] == 4     # nothing left to do
    with pytest.raises(ValueError, match="settings"):
        TR.train(data, held, path, TR.Settings(classes=3, width=256, steps=30, rate=0.1))
    with pytest.raises(ValueError, match="places"):
        TR.train(data, held, path, TR.Settings(classes=1000, width=1 << 20))
    history = saved.history().withColumn("step", F.col("step") * 10)
    losses = {r["step"]: r["loss"] for r in history.collect()}
    best = EV.best_checkpoint(history).first()
    assert best["step"] == min((v, k) for k, v in losses.items() if k % 50 == 0)[1]


def test_no_rows(spark, sides):
    settings, (data, held) = sides
    n, loss, g = TR.loss_and_gradient(data.limit(0), np.zeros((3, 257)))
    assert (n, loss) == (0, 0) and not g.any()


def test_count_model_equals_a_loop(spark):
    import math
    from collections import Counter
    from askbase.operators import count_model as CM
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices("a b c d e f".split(), k=rnd.randrange(0, 9))), rnd.choice([0, 1, 1, 2])) for i in range(120)]
    rows += [(200, None, 1), (201, "a ? b", None), (202, "!!", 0)]
    df = spark.createDataFrame(rows, "id int, text string, label int").repartition(3)
    model = CM.fit(df)
    count, total, docs = {c: Counter() for c in range(3)}, Counter(), Counter(r[2] for r in rows if r[2] is not None)
    clean = lambda t: [w for w in (t or "").split() if w not in ("?", "!!")]
    for _, t, c in rows:
        if c is not None:
            count[c].update(clean(t))
            total[c] += len(clean(t))
    vocabulary = len({w for c in count.values() for w in c})
    asked = rows + [(300, "a zzz b b", None)]

    def best(t):
        return min((-round(math.log(docs[c] / sum(docs.values())) + sum(math.log(count[c][w] + 1) for w in clean(t) if w in {
            x for k in count.values() for x in k}) - len(clean(t)) * math.log(total[c] + vocabulary + 1), 9), c) for c in range(3))

    got = {r["id"]: (-r["score"], r["pred"]) for r in CM.predict(
        model, spark.createDataFrame(asked, "id int, text string, label int"), ["id"]).collect()}
    assert got.keys() == {r[0] for r in asked}
    for i, t, _ in asked:
        low, c = best(t)
        assert got[i][1] == c and abs(got[i][0] - low) < 1e-8
    assert CM.predict(model, df.limit(0), ["id"]).count() == 0 and CM.predict(CM.fit(df.limit(0)), df, ["id"]).count() == 0


def test_rules_with_the_same_phrase_meet_the_texts_once(spark, monkeypatch):
    """`route_rules`: thousands of rules that share a phrase are reduced before the join, and the first still wins."""
    kept, keep = {}, RT._kept
    monkeypatch.setattr(RT, "_kept", lambda df, name: kept.setdefault(name, keep(df, name)))
    rules = [("xy"[i % 2], 3000 - i, f"r{i}", "ab"[i % 4 // 2]) for i in range(3000)] + [("x", 1, "r0", "b"), ("x", 1, "q", "b")]
    texts = [(i, "ab" * (i % 3)) for i in range(30)]
    got = RT.route_by_rules(spark.createDataFrame(texts, "question_id long, text string"), spark.createDataFrame(rules, RT.RULES)).collect()
    assert {tuple(r) for r in got} == {(i, "x", "q", 1, "b") if t and p == "x" else (i, "y", "r2999", 1, "b") if t else
                                       (i, p, None, None, None) for i, t in texts for p in "xy"}
    assert kept["first-rules"].count() == 4
