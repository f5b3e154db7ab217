"""M1 / M2 against the standard library and the textbook LCS."""

import random
from difflib import SequenceMatcher

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from askbase.functions import similarity as S
from askbase.functions.text import token_sort_key
from askbase.operators import gate as G


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[-1]))
        prev = cur
    return prev[-1]


def py_key(s):
    import re
    s = s.translate(dict.fromkeys(range(128, 256)))
    s = re.sub(r"(?ui)\W", " ", s).lower().strip()
    return " ".join(sorted(s.split())).strip()


def py_indel(p, q):
    if p == q:
        return 100
    if not p or not q:
        return 0
    return int(round(100 * (2.0 * lcs(p, q) / (len(p) + len(q)))))


def test_bitparallel_lcs_matches_dp(spark):
    random.seed(7)
    rows = []
    for _ in range(400):
        la, lb = random.choice([0, 1, 7, 30, 62, 63, 64, 125, 190]), random.choice([0, 1, 7, 30, 62, 63, 64, 125, 190])
        a = "".join(random.choice("abcşığ ") for _ in range(la))
        b = "".join(random.choice("abcşığ ") for _ in range(lb))
        rows.append((a, b, lcs(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, want int").withColumnRenamed("b", "pkey")
    feats = G.key_features(df.select("pkey").distinct())
    j = df.join(feats, "pkey").withColumn("achars", S.chars_of("a")).withColumn(
        "got", S.lcs_length("achars", "plen", "pnw", "pmasks", "pinit"))
    assert j.filter("got <> want").count() == 0


def test_pair_scores_match_python(spark):
    pairs = [("small ring", "ring small"), ("SMALL RING?", "small ring"), ("all ring", "small ring"),
             ("smal nedir acaba", "small ring"), ("zzq Brand#2", "red widget"), ("", "red widget"),
             ("?", "!"), ("çok güzel şey", "güzel çok şey"), ("a" * 70 + "b", "b" + "a" * 69)]
    df = spark.createDataFrame(pairs, "q string, p string")
    got = {(r.q, r.p): r.score for r in G.pair_scores(df, "q", "p").collect()}
    for q, p in pairs:
        assert got[(q, p)] == py_indel(py_key(p.lower()), py_key(q.lower())), (q, p)


def test_half_even_rounding(spark):
    # 2*109/400 -> 54.50000000000001 in doubles, which rounds to 55 in Python too
    r = spark.range(1).select(S.ratio_from_matches(F.lit(109), F.lit(400)).alias("a"),
                              S.ratio_from_matches(F.lit(109), F.lit(436)).alias("b")).first()
    assert r.a == int(round(100 * (2.0 * 109 / 400)))
    assert r.b == int(round(100 * (2.0 * 109 / 436)))
    # an exact tie: 100 * 2/16 = 12.5 -> 12 (half-even), 100 * 6/16 = 37.5 -> 38
    t = spark.range(1).select(S.ratio_from_matches(F.lit(1), F.lit(16)).alias("a"),
                              S.ratio_from_matches(F.lit(3), F.lit(16)).alias("b")).first()
    assert (t.a, t.b) == (int(round(100 * (2.0 * 1 / 16))), int(round(100 * (2.0 * 3 / 16)))) == (12, 38)


def test_exact_ratio_matches_difflib_and_bounds(spark):
    random.seed(3)
    words = ["small", "ring", "red", "widget", "blue", "bolt", "hot", "gear", "şık", "güzel"]
    pairs = [(" ".join(random.sample(words, 2)), " ".join(random.sample(words, random.randint(1, 4))))
             for _ in range(200)]
    pairs.append(("x" * 250, "x" * 120 + "y" * 130))  # autojunk heuristic on >= 200 chars
    df = spark.createDataFrame(pairs, "q string, p string")
    exact = {(r.q, r.p): r.score for r in G.pair_scores(df, "q", "p", exact=True).collect()}
    indel = {(r.q, r.p): r.score for r in G.pair_scores(df, "q", "p").collect()}
    for q, p in pairs:
        pk, qk = py_key(p.lower()), py_key(q.lower())
        want = 100 if pk == qk else (0 if not pk or not qk else
                                     int(round(100 * SequenceMatcher(None, pk, qk).ratio())))
        assert exact[(q, p)] == want
        assert indel[(q, p)] >= exact[(q, p)]


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="abcXYZ şüİı!?", max_size=30))
def test_token_sort_key_matches_python(spark, s):
    got = spark.createDataFrame([(s,)], "s string").select(token_sort_key("s").alias("k")).first().k
    assert got == py_key(s)


def test_matched_blocks_equal_difflib(spark):
    """Short alphabets (many ties), long texts with popular characters, empty keys."""
    rnd = random.Random(9)
    word = lambda n, abc: "".join(rnd.choices(abc, k=n))
    pairs = [(word(rnd.randrange(0, 14), "ab"), word(rnd.randrange(0, 14), "abc")) for _ in range(300)]
    pairs += [(word(rnd.randrange(1, 40), "abcdefşğ "), word(rnd.randrange(1, 40), "abcdefşğ ")) for _ in range(150)]
    pairs += [(word(rnd.randrange(20, 60), "abcdefghij "), word(rnd.randrange(198, 240), "abcdefghij xyz1234567890")) for _ in range(25)]
    pairs += [("a" * 30 + "bcd", "a" * 150 + "bcd" + "x" * 60), ("xaaab", "a" * 210 + "b"), ("abc", "abc"), ("", "a"), ("a", "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").repartition(8)
    got = {r["i"]: r["s"] for r in df.select("i", S.exact_score("a", "b").alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        want = 100 if a == b else 0 if not a or not b else int(round(100 * SequenceMatcher(None, a, b).ratio()))
        assert got[i] == want, (a, b)
    null = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "a string, b string")
    assert [r["s"] for r in null.select(S.exact_score("a", "b").alias("s")).collect()] == [None] * 3


def test_first_passing_equals_a_loop(monkeypatch):
    """The block comparison of the fuzzy gate: first pattern over the threshold, any length, character and block."""
    import random
    rnd = random.Random(4)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    def passes(a, b, t):
        return a == b or bool(a and b) and round(100.0 * (2.0 * lcs(a, b) / (len(a) + len(b)))) >= t

    def text():
        return "".join(rnd.choices("abçş😀d ", k=rnd.choice([0, 1, 4, 20, 61, 62, 63, 130])))

    monkeypatch.setattr(S, "BLOCK_PATTERNS", 40)
    monkeypatch.setattr(S, "BLOCK_KEYS", 7)
    for t in (20, 55, 90):
        keys, patterns = [text() for _ in range(60)] + [None], [text() for _ in range(90)]
        want = [next((i for i, p in enumerate(patterns) if k is not None and passes(k, p, t)), -1) for k in keys]
        assert S.first_passing(keys, patterns, t).tolist() == want
    assert S.first_passing(["a", None], [], 55).tolist() == [-1, -1] and S.first_passing([], ["a"], 55).tolist() == []
