"""Quality rules (operator 9): a short-circuit cascade ordered by rejection per cost.

Every document gets its base counts.  Documents that pass the base limits run
through the rules one by one and stop at the first that rejects.  The order
is fitted: on a sample bounded by ``sample_docs`` each rule's seconds and the
share it rejects are measured, and rules are sorted by share per second.  The
verdict is the conjunction of the rules, so the order changes time, not results.

Edge cases: null or blank text has no words and fails the base limit; repeated
rows and null ids are judged row by row; extra columns are ignored.

One Arrow pass without a shuffle, whole texts, memory of one batch.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from askbase.llm.common import hash_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, rejected_by string")
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
_HAS_LETTER = re.compile(r"[A-Za-z\x80-\U0010ffff]")
_CAPS, _SMALL = re.compile(r"[A-Z]"), re.compile(r"[a-z]")


def repeat_words(words: list[str]) -> int:
    """Words inside a 3-word window that the text holds at least twice."""
    n = len(words)
    if n < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    count = Counter(grams)
    total, covered_to = 0, 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            total += i + 3 - max(i, covered_to)
            covered_to = i + 3
    return total


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def base_counts(text: str | None) -> tuple[list[str], tuple[int, int, int, int, int], bool]:
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    repeat = repeat_words(words)
    counts = (n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup_lines(text), repeat)
    return words, counts, n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PCT * n


# A rule takes (text, words, counts) and says whether it rejects.
def many_symbols(text, words, c) -> bool:
    """Over one symbol in ten words."""
    return 10 * c[2] > c[0]


def odd_word_length(text, words, c) -> bool:
    """Mean word length outside 2 to 15 code points."""
    return c[1] < 2 * c[0] or c[1] > 15 * c[0]


def repeated_lines(text, words, c) -> bool:
    """Over a half of the lines repeat an earlier one."""
    return 2 * c[3] > text.count("\n") + 1


def letterless_words(text, words, c) -> bool:
    """Over a fifth of the words hold no letter."""
    return 5 * sum(1 for w in words if not _HAS_LETTER.search(w)) > c[0]


def shouting(text, words, c) -> bool:
    """Over a half of the letters A-Z, a-z are capitals."""
    caps = len(_CAPS.findall(text))
    return caps > len(_SMALL.findall(text))


def one_word_dominates(text, words, c) -> bool:
    """One word makes up over three tenths of the text."""
    return 10 * max(Counter(words).values()) > 3 * c[0]


RULES: dict[str, Callable] = {f.__name__: f for f in (
    many_symbols, odd_word_length, repeated_lines, letterless_words, shouting, one_word_dominates)}


def fit_order(docs: DataFrame, rules: dict[str, Callable] = RULES, sample_docs: int = 2000) -> list[str]:
    """Rule names by rejected share per second, measured on at most about
    ``sample_docs`` documents chosen by the hash of their text."""
    n = docs.count()
    if not n:
        return list(rules)
    sample = hash_sample(docs.select("text"), "text", sample_docs, n, seed=9)

    def measure(batches):
        cost, out, seen = Counter(), Counter(), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                words, counts, failed = base_counts(text)
                if failed:
                    continue
                seen += 1
                for name, rule in rules.items():
                    began = time.perf_counter()
                    out[name] += rule(text, words, counts)
                    cost[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(rules)), pa.array([cost[k] for k in rules], pa.float64()),
             pa.array([out[k] for k in rules], pa.int64()), pa.array([seen] * len(rules), pa.int64())],
            names=["rule", "cost", "rejected", "seen"])

    got = sample.mapInArrow(measure, "rule string, cost double, rejected long, seen long").groupBy("rule").agg(
        F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected"), F.sum("seen").alias("seen")).collect()
    rate = {r["rule"]: (r["rejected"] / max(r["seen"], 1)) / max(r["cost"], 1e-9) for r in got}
    return sorted(rules, key=lambda k: (-rate.get(k, 0.0), k))


def apply_rules(docs: DataFrame, order: list[str] | None = None, rules: dict[str, Callable] = RULES) -> DataFrame:
    """Base counts, verdict and the first rejecting rule of every row."""
    order = list(order) if order is not None else fit_order(docs, rules)
    assert sorted(order) == sorted(rules), "the order names every rule once"
    cascade = [(k, rules[k]) for k in order]

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                words, counts, failed = base_counts(text)
                by = "base" if failed else next((k for k, rule in cascade if rule(text, words, counts)), None)
                rows.append((*counts, failed, by is None, by))
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:5]),
                 *(pa.array(c, pa.bool_()) for c in cols[5:7]), pa.array(cols[7], pa.string())],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "rejected_by"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
