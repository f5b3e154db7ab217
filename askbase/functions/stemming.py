"""Porter stemming (T4) as native expressions over the distinct words of a table.

A text's words are exploded, reduced to the distinct ones, stemmed once each, and joined
back by word; so the cost of stemming follows the vocabulary, and a word that a
third of all texts hold is stemmed once.

The published 1980 algorithm works on the *form* of a word, its letters as c
(consonant) and v (vowel; y behind a consonant is one).  The form of a beginning of a word is
the beginning of its form, so it is made once per step; the measure m is the number of "vc" in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from askbase.operators.sizing import sized_broadcast
from askbase.session import scratch_path

# --- fixed values: Porter (1980) step 2, step 3 and step 4 suffix rules ---
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
         ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
         "ism", "ate", "iti", "ous", "ive", "ize"]


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value`` once (a column in a lambda would be evaluated again at each use)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _form(w: str) -> str:
    letter = ("CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') THEN 'v' WHEN ch = 'y' AND endswith(a, 'c') THEN 'v' ELSE 'c' END")
    chars = f"transform(sequence(1, greatest(1, length({w}))), i -> substring({w}, i, 1))"
    return f"IF({w} = '', '', aggregate({chars}, '', (a, ch) -> concat(a, {letter})))"


def _m(form: str) -> str:
    return f"(length({form}) - length(replace({form}, 'vc', '')))"          # twice the measure


def _cut(x: str, n: int) -> str:
    """``x`` (the word w or its form f) without the last ``n`` letters."""
    return f"left({x}, length(w) - {n})"


def _doubled(w: str, f: str) -> str:
    return f"(length({w}) >= 2 AND right({w}, 1) = left(right({w}, 2), 1) AND endswith({f}, 'c'))"


def _cvc(w: str, f: str) -> str:
    return f"(endswith({f}, 'cvc') AND right({w}, 1) NOT IN ('w', 'x', 'y'))"


def _step(expr: str, rest: str) -> str:
    """``rest`` with w and its form f after ``expr``, which is over the w and f before it."""
    return _let(expr, "w", _let(_form("w"), "f", rest))


def _suffixes(table: list[tuple[str, str]], cond) -> str:
    """The first rule whose suffix the word has; ``cond(suffix)`` decides whether it applies."""
    rules = [f"WHEN endswith(w, '{s}') THEN IF({cond(s)}, concat({_cut('w', len(s))}, '{r}'), w)" for s, r in table]
    return "CASE " + " ".join(rules) + " ELSE w END"


def _stem_sql(word: str) -> str:
    one_a = (f"CASE WHEN endswith(w, 'sses') OR endswith(w, 'ies') THEN {_cut('w', 2)} WHEN endswith(w, 'ss') THEN w "
             f"WHEN endswith(w, 's') THEN {_cut('w', 1)} ELSE w END")
    # what is left of a word that loses its ending is marked by a blank in front
    one_b = (f"CASE WHEN endswith(w, 'eed') THEN IF({_m(_cut('f', 3))} > 0, {_cut('w', 1)}, w) "
             f"WHEN endswith(w, 'ed') AND contains({_cut('f', 2)}, 'v') THEN concat(' ', {_cut('w', 2)}) "
             f"WHEN endswith(w, 'ing') AND contains({_cut('f', 3)}, 'v') THEN concat(' ', {_cut('w', 3)}) ELSE w END")
    mended = (f"CASE WHEN endswith(w, 'at') OR endswith(w, 'bl') OR endswith(w, 'iz') THEN concat(w, 'e') "
              f"WHEN {_doubled('w', 'f')} AND right(w, 1) NOT IN ('l', 's', 'z') THEN {_cut('w', 1)} "
              f"WHEN {_m('f')} = 2 AND {_cvc('w', 'f')} THEN concat(w, 'e') ELSE w END")
    again = f"IF(startswith(w0, ' '), {_let('substring(w0, 2)', 'w', _let(_form('w'), 'f', mended))}, w0)"
    one_c = f"IF(endswith(w, 'y') AND contains({_cut('f', 1)}, 'v'), concat({_cut('w', 1)}, 'i'), w)"
    some = lambda s: f"{_m(_cut('f', len(s)))} > 0"
    four = lambda s: (f"{_m(_cut('f', len(s)))} > 2" + (
        f" AND right({_cut('w', 3)}, 1) IN ('s', 't')" if s == "ion" else ""))
    e = _cut("f", 1)
    five_a = (f"IF(endswith(w, 'e') AND ({_m(e)} > 2 OR ({_m(e)} = 2 AND NOT {_cvc(_cut('w', 1), e)})), {_cut('w', 1)}, w)")
    five_b = f"IF({_m('f')} > 2 AND {_doubled('w', 'f')} AND endswith(w, 'l'), {_cut('w', 1)}, w)"
    tail = _step(one_c, _step(_suffixes(STEP2, some), _step(_suffixes(STEP3, some), _step(
        _suffixes([(s, "") for s in STEP4], four), _step(five_a, five_b)))))
    body = _step(one_a, _let(one_b, "w0", _step(again, tail)))
    return f"IF(length({word}) <= 2, {word}, {_let(word, 'w', body)})"


def stem(word: str) -> Column:
    """The stem of a lower-case word; ``word``: a column name."""
    return F.expr(_stem_sql(word))


def stem_tokens(df: DataFrame, keys: list[str], tokens: str, out: str = "stemmed") -> DataFrame:
    """T4: ``keys`` and the stemmed ``tokens`` joined with one blank, in order.  ``keys`` name a row;
    null tokens give null, none give ''."""
    x = df.select(*keys, F.col(tokens).isNull().alias("_null"), F.posexplode_outer(tokens).alias("_at", "_word"))
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "stems")
    words = x.select("_word").filter(F.col("_word").isNotNull()).distinct()
    words.select("_word", stem("_word").alias("_stem")).write.parquet(path)
    stems = sized_broadcast(spark.read.parquet(path))
    back = x.join(stems, "_word", "left").groupBy(*keys).agg(
        F.first("_null").alias("_null"), F.sort_array(F.collect_list(F.struct("_at", "_stem"))).alias("_s"))
    text = F.array_join(F.transform("_s", lambda s: s["_stem"]), " ")
    return back.select(*keys, F.when(~F.col("_null"), text).alias(out))
