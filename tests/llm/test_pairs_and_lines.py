"""Operators 2, 4, 8 and 9 against brute force and on edge cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from askbase.llm import components as cc, decontaminate, line_dedup, ngram_join, quality_rules
from tests.llm.helpers import components, edge_docs, key, with_clashes


def near_copies(seed, n=140):
    """Documents of many sizes with copies that differ by few words."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(n // 7):
        words = rnd.choices(vocab, k=rnd.choice([1, 2, 3, 9, 12, 13, 20, 25, 40, 70, 120, 300, 700]))
        for _ in range(7):
            w = list(words)
            for _ in range(rnd.randrange(0, 2 + len(w) // 40)):
                k = rnd.randrange(len(w))
                w[k:k + 1] = rnd.choice([[rnd.choice(vocab)], [], [w[k], rnd.choice(vocab)]])
            rows.append(" ".join(w))
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,need", [(1, 90), (2, 90), (3, 80), (4, 97)])
def test_components_equal_all_pairs(spark, seed, need):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           ngram_join.jaccard_components(docs, need=need).collect()}
    assert got == components(rows, need)


def test_tiled_blocks_equal_whole_blocks(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(200)] = f"x{rnd.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows)
    assert 1 < len(Counter(c for _, c in want.values())) < 90
    for sets in (7, 1024):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
               ngram_join.jaccard_components(docs, block_sets=sets).collect()}
        assert got == want


@pytest.mark.parametrize("sizes", [(9, 10), (10, 11), (18, 20), (95, 100), (540, 600)])
def test_linked_sets_share_a_signature(sizes):
    import numpy as np
    levels, rnd = ngram_join.Levels(90, 100), np.random.default_rng(1)
    for _ in range(60):
        y = rnd.integers(0, 2 ** 63, sizes[1], dtype=np.uint64)
        x = np.unique(y[:sizes[0]])
        y = np.unique(y)
        inter = len(np.intersect1d(x, y))
        if 100 * inter >= 90 * (len(x) + len(y) - inter):
            assert set(ngram_join.signatures(x, levels)) & set(ngram_join.signatures(y, levels))


@pytest.mark.parametrize("size", [30, 100, 256, 1030])
def test_linked_sets_at_four_fifths_share_a_signature(size):
    import numpy as np
    levels, rnd = ngram_join.Levels(80, 100), np.random.default_rng(2)
    linked = 0
    for _ in range(60):
        own = rnd.integers(0, 2 ** 63, 2 * size, dtype=np.uint64)
        a, b = (size // 9, size // 9) if rnd.random() < .5 else (0, size // 4)     # changed in both, or only more in one
        x, y = np.unique(own[:size]), np.unique(np.concatenate([own[a:size], own[size:size + b]]))
        inter = len(np.intersect1d(x, y))
        if 100 * inter >= 80 * (len(x) + len(y) - inter):
            linked += 1
            assert set(ngram_join.signatures(x, levels)) & set(ngram_join.signatures(y, levels))
    assert linked > 20


def test_sets_that_only_share_signatures_make_no_block(spark):
    import numpy as np
    levels, own = ngram_join.Levels(80, 100), np.random.default_rng(3).integers(0, 2 ** 63, 20_000, dtype=np.uint64)
    grams = [np.unique(np.concatenate([own[:90], own[200 * i + 100:200 * i + 150]])) for i in range(60)]
    rows = [(i, len(g), i + 1, i, ngram_join.sketch_of(g), [1] + ngram_join.signatures(g, levels).view(np.int64).tolist())
            for i, g in enumerate(grams)]
    signed = spark.createDataFrame(rows, ngram_join.SIGNED)
    classes = signed.select("hi", "lo", F.col("doc_id").alias("rep"), "n")
    assert ngram_join._blocks(signed, classes, 80, 100, 1 << 14).count() == 0
    near = spark.createDataFrame([(99, len(grams[5]), 500, 99, ngram_join.sketch_of(grams[5][1:]), [1])], ngram_join.SIGNED)
    classes = classes.unionByName(near.select("hi", "lo", F.col("doc_id").alias("rep"), "n"))
    for sets in (7, 1 << 14):
        got = ngram_join._blocks(signed.unionByName(near), classes, 80, 100, sets).collect()
        assert {r["rep"] for r in got} == {5, 99}


def test_sketches_lose_no_link():
    import numpy as np
    rnd = np.random.default_rng(4)
    for size in (1, 9, 60, 130, 500, 3000):
        for need in (80, 90):
            own = rnd.integers(0, 2 ** 63, 2 * size + 9, dtype=np.uint64)
            longest = size * 100 // need
            for y in (own[:longest], own[size // 19:size + size // 19]):
                x, y = np.unique(own[:size]), np.unique(y)
                inter = len(np.intersect1d(x, y))
                linked = 100 * inter >= need * (len(x) + len(y) - inter)
                got = ngram_join.alike(np.array([len(x), len(y)]), [ngram_join.sketch_of(x), ngram_join.sketch_of(y)], need, 100)
                assert got == [(0, 1)] or not linked


def test_components_edge_cases(spark):
    docs = with_clashes(edge_docs(spark))
    rows = ngram_join.jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by[0] == [(0, 0)] and by[2] == [(0, 2)] and by[6] == [(1, 6)] and by[7] == [(1, 6)] and by[8] == [(1, 6)]
    assert sorted(by[None]) == [(0, None), (1, None)]
    assert by[3] == [(0, 3), (0, 3)]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(by) - {7, 8}
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_an_id_with_several_texts_keeps_the_links_of_all(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (5, "x y z w"), (5, "x y z w"), (9, "other words here")]
    rows += [(None, "Null  id"), (None, "null id"), (None, None), (None, ""), (4, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 5), (9, 9), (4, 4), (None, None)}
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs).collect()), key=repr)
    assert len(kept) == 6 and [k for k in kept if k[0] == 5] == [(5, "x y z w")] and (1, a) in kept
    assert sum(i is None for i, _ in kept) == 2


def test_connected_on_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 300), (None, 4)]
    got = {r["node"]: r["component"] for r in cc.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 300: 300}
    assert cc.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_hits(words, patterns):
    hit, items = set(), set()
    for p, ids in patterns.items():
        for i in range(len(words) - len(p) + 1):
            if tuple(words[i:i + len(p)]) == p:
                hit.update(range(i, i + len(p)))
                items |= ids
    return hit, items


def test_wu_manber_equals_naive_search():
    rnd = random.Random(3)
    for _ in range(300):
        vocab = [b"a", b"b", b"c", b"d"][:rnd.randrange(1, 5)]
        items = [(str(i), " ".join(x.decode() for x in rnd.choices(vocab, k=rnd.randrange(0, 9)))) for i in range(5)]
        window = rnd.randrange(1, 6)
        tables = decontaminate.build(items, window)
        patterns = {p: ids for t in tables for p, ids in t.patterns.items()}
        words = rnd.choices(vocab + [b"z"], k=rnd.randrange(0, 40))
        assert decontaminate.search(words, tables) == brute_hits(words, patterns)


def test_decontamination_slices_and_edges(spark):
    docs = with_clashes(edge_docs(spark))
    bench = spark.createDataFrame([(1, "The CAT, sat on the mat the cat sat on the mat"), (2, "one two"), (2, "one two"), (3, None),
                                   (None, "a b c"), (4, ""), (5, "a-b c")], "item_id long, text string")
    whole = decontaminate.find_benchmark(docs, bench).collect()
    cut = decontaminate.find_benchmark(docs, bench, table_bytes=64).collect()
    assert key(whole) == key(cut) and len(whole) == docs.count()
    by = {r["doc_id"]: r for r in whole if r["doc_id"] is not None}
    assert by[11]["items"] == ["1"] and len(by[11]["hits"]) == 180
    assert by[5]["items"] == ["2"] and by[6]["items"] == ["5"] and by[4]["hits"] == [] and by[0]["n_words"] == 0
    assert decontaminate.find_benchmark(docs.limit(0), bench).count() == 0
    none = decontaminate.find_benchmark(docs, bench.limit(0)).collect()
    assert len(none) == docs.count() and not any(r["hits"] for r in none)


def test_benchmark_items_without_id_mark_hits(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "four five"), (3, "six")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), (None, "four five"), (7, "Four five")], "item_id long, text string")
    for size in (16 << 20, 64):
        got = {r["doc_id"]: (r["hits"], r["items"]) for r in
               decontaminate.find_benchmark(docs, bench, table_bytes=size).collect()}
        assert got == {1: ([1, 2, 3], []), 2: ([0, 1], ["7"]), 3: ([], [])}


def brute_lines(rows, least):
    def k(line):
        return line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})

    count = Counter(x for _, t in rows for x in {k(line) for line in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k(x)) >= 1 and count[k(x)] >= least)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_equals_brute_force(spark):
    docs = with_clashes(edge_docs(spark))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(200 + i, "Common line\n own %d \n\xa0\n\nCOMMON LINE \r" % i) for i in range(5)] + [(200, "Common line\n own 0 \n\xa0\n\nCOMMON LINE \r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least, batches in ((2, 1), (3, 4), (6, 3)):
        got = line_dedup.drop_frequent_lines(docs, min_docs=least, batches=batches)
        assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()),
                      key=repr) == brute_lines(rows, least)
    assert line_dedup.drop_frequent_lines(docs.limit(0)).count() == 0


def test_line_runs_are_levelled_and_incremental(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for b in range(5):
        runs.ingest(spark.createDataFrame([(i, i) for i in range(b, b + 3)], "h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r["h1"], r["n"]) for r in runs.merged().collect()} == {(0, 1), (1, 2), (2, 3), (3, 3), (4, 3), (5, 2), (6, 1)}
    assert [r["h1"] for r in runs.unseen(spark.createDataFrame([(6, 6), (9, 9)], "h1 long, h2 long")).collect()] == [9]


def test_rules_do_not_depend_on_their_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fitted = quality_rules.fit_order(docs)
    assert sorted(fitted) == sorted(quality_rules.RULES)
    pick = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    a = key(quality_rules.apply_rules(docs, fitted).select(pick).collect())
    assert a == key(quality_rules.apply_rules(docs, fitted[::-1]).select(pick).collect())


def test_repeat_words_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        w = rnd.choices("abcd", k=rnd.randrange(0, 25))
        grams = Counter(zip(w, w[1:], w[2:]))
        want = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(i, i + 3)}
        assert quality_rules.repeat_words(w) == len(want)


def test_rules_edge_cases(spark):
    docs = with_clashes(edge_docs(spark))
    rows = quality_rules.apply_rules(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[0]["n_words"] == 0 and by[0]["base_failed"] and not by[0]["kept"]
    assert by[13]["n_dup_lines"] == 2 and by[15]["n_repeat_words"] == 20000
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0
