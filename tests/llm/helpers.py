"""Fixtures and plain brute-force twins of the operators."""

import re
import sys
from itertools import combinations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

EDGE_TEXTS = [
    None, "", "   ", "\n\n", "one", "one two", "a b c", "a b c", "A b\tC", "x" * 5000, "é à ü " * 40,
    "the cat sat on the mat " * 30, "- - -", "line\nline\nline", "İstanbul ß ﬁ <|endoftext|> it's",
    "word " * 20000,
]


def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and a null id."""
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(3, "\n\n", "en", "s", 1), (100, None, None, None, None), (None, "a b c", "en", "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def with_clashes(df):
    """Extra columns with names that the operators use inside."""
    from pyspark.sql import functions as F
    for c in ("tk", "n", "hi", "lo", "sig", "block", "words", "kept", "rate", "hits", "u", "v", "component", "h1", "pos"):
        df = df.withColumn(c, F.lit("x"))
    return df


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def components(rows, need=90, per=100, n=3):
    """rows: (doc_id, text).  doc_id -> (set size, smallest reachable id)."""
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and per * len(x & y) >= need * len(x | y):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return {i: (len(s), root(i)) for i, s in sets.items()}


sys.setrecursionlimit(10_000)
