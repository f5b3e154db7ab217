"""Operators 11, 12 and 13 against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from askbase.llm import graph_index, prefix_trie, whitening
from tests.llm.helpers import with_clashes

TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
NONE = hashlib.sha256(b"").hexdigest()


def brute_trie(rows):
    """Rows (conv_id, turn, role, text) to one tuple per node."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    totals = {}
    for n in sorted(members, key=len, reverse=True):
        kids = children[n]
        saved = (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0)
        totals[n] = (1 if not kids else sum(totals[k][0] for k in kids), saved + sum(totals[k][1] for k in kids))
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(n))
        out.append((m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children[n]), *totals[n],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(df):
    turns = prefix_trie.rank_turns(df)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.borrow_heads(turns)).collect()), key=repr)


def conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-20, 80), 45):
        for t in range(rnd.choice([1, 1, 2, 3, 5, 9, 12, 20, 40])):
            rows.append((c, t * 2, rnd.choice(["user", "bot", None]), rnd.choice(["hi", "yes", "no", "é ş", "", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = conversations(seed)
    assert trie(spark.createDataFrame(rows, TURNS).repartition(5)) == brute_trie(rows)


def test_trie_of_deep_conversations_crosses_bands(spark, monkeypatch):
    rnd = random.Random(3)
    base = [("user" if t % 2 else "bot", rnd.choice("abc") * rnd.randrange(9)) for t in range(150)]
    rows = []
    for c in range(100, 140):
        same = rnd.choice([0, 4, 31, 32, 33, 64, 90, 149, 150])
        turns = base[:same] + [("user", str(rnd.randrange(3))) for _ in range(rnd.randrange(1, 70))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    df = spark.createDataFrame(rows, TURNS).repartition(6)
    want = brute_trie(rows)
    assert max(r[1] for r in want) > 150
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 2)
    for band in (4, 16):                       # four levels of bands, and two
        monkeypatch.setattr(prefix_trie, "BAND", band)
        assert trie(df) == want


def test_trie_edge_cases(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (1, None, "b", "z"), (1, None, None, None), (None, 1, "u", "x"),
            (2, 5, "u", "x" * 100_000), (-7, 1, "u", "a"), (-5, 1, "u", "a"), (10, 3, "b", "q"), (10, 3, "a", "q"), (11, 0, "u", "a")]
    df = with_clashes(spark.createDataFrame(rows, TURNS)).withColumnRenamed("h1", "depth")
    assert trie(df) == brute_trie(rows)
    assert trie(df.limit(0)) == []
    only = spark.createDataFrame([(13, 1, "u", "a")], TURNS)     # all of its turns are replaced by none
    assert zlib.crc32(b"13") % 9 > 0
    assert trie(only) == [(13, 0, None, 1, 0, 1, 0, hashlib.sha256(b"13").hexdigest())]


def test_trie_of_many_copies(spark):
    rows = [(c, t, "u", f"t{t}") for c in range(0, 3000, 5) for t in range(3)] + [(7, 0, "u", "x")]
    assert trie(spark.createDataFrame(rows, TURNS)) == brute_trie(rows)


def brute_nearest(rows, every, k):
    """(query_id, vec_id, score) in order, over rows of a usual length."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None})
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], np.float64)
    out = defaultdict(list)
    for i, v in good:
        if i % every == 0:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
            o = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] += [(int(ids[j]), float(d[j])) for j in o]
    return out


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((3000, 24)) + 3 * rng.integers(0, 3, (3000, 1))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS)
    want = brute_nearest([(i, v) for i, v, _ in rows], 100, 10)
    for shard_rows in (600, 4096):
        got = defaultdict(list)
        for r in sorted(graph_index.nearest(df, shard_rows=shard_rows).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got[r["query_id"]].append((r["vec_id"], r["score"]))
            assert r["rank"] == len(got[r["query_id"]])
            assert r["score"] == pytest.approx(np.sqrt(((x[r["vec_id"]].astype(float) - x[r["query_id"]]) ** 2).sum()), rel=1e-14)
        hits = sum(len({v for v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items())
        assert len(got) == 30 and all(len(g) == 10 for g in got.values())
        assert hits / 300 >= 0.97


def test_search_with_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    few = rng.integers(-2, 3, (25, 4)).astype(np.float32) + 0.5
    rows = [(i, few[i % 25].tolist(), 0) for i in range(400)] + [(1000 + i, few[0].tolist(), 0) for i in range(600)]
    odd = [(401, None, 0), (402, [1.0, 2.0], 0), (403, [0.0] * 4, 0), (404, [float("nan"), 1.0, 1.0, 1.0], 0), (405, [None, 1.0, 1.0, 1.0], 0),
           (406, [float("inf"), 1.0, 1.0, 1.0], 0), (500, [0.0, -0.0, 0.0, 0.0], 0), (None, [9.0] * 4, None), (3, few[3].tolist(), 0)]
    df = with_clashes(spark.createDataFrame(rows + odd, VECTORS)).repartition(3)
    got = graph_index.nearest(df, every=100, k=10, shard_rows=8).orderBy("query_id", "rank").collect()
    want = brute_nearest([(i, v) for i, v, _ in rows], 100, 10)
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(q, v) for q in sorted(want) for v, _ in want[q]]
    assert [r["score"] for r in got] == [s for q in sorted(want) for _, s in want[q]]


def test_search_on_tiny_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (7, [0.0, 2.0], 0), (5, [1.0, 0.0], 0)], VECTORS)
    got = [tuple(r) for r in graph_index.nearest(df).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 0.0), (0, 2, 7, float(np.sqrt(5.0)))]
    assert graph_index.nearest(df.limit(0)).count() == 0
    assert graph_index.nearest(df.filter("vec_id = 0")).count() == 0
    wide = df.selectExpr("vec_id", "cast(embedding as array<double>) as embedding")
    assert [tuple(r) for r in graph_index.nearest(wide).orderBy("rank").collect()] == got


def test_graph_edges_are_diverse_and_reach_all():
    x = np.random.default_rng(6).standard_normal((900, 12))
    g = graph_index.Graph(x)
    reached, queue = {int(i) for i in g.order[:graph_index.STARTS]}, g.order[:graph_index.STARTS].tolist()
    while queue:
        for j in g.edges[queue.pop()]:
            if j < g.n and j not in reached:
                reached.add(int(j))
                queue.append(int(j))
    assert len(reached) == 900
    kept = g._prune(np.array([0]), np.arange(900, dtype=np.int32)[None, :])[0]
    kept = kept[kept < 900]
    d = lambda a, b: ((g.x[a] - g.x[b]) ** 2).sum()
    for a, j in enumerate(kept):
        assert all(graph_index.ALPHA ** 2 * d(i, j) > d(0, j) * (1 - 1e-4) for i in kept[:a])


@pytest.mark.parametrize("dims,count", [(1, 8), (3, 8), (10, 3), (64, 8), (150, 8)])
def test_solver_equals_dense_solver(dims, count):
    a = np.random.default_rng(dims).standard_normal((dims, dims))
    v = a @ a.T
    e, u = whitening.jacobi_davidson(lambda w: v @ w, dims, count)
    want, axes = np.linalg.eigh(v)
    want, axes = want[::-1][:count], axes[:, ::-1][:, :count]
    assert np.allclose(e, want, rtol=0, atol=1e-13 * want[0])
    assert np.abs(np.abs((u * axes).sum(axis=0)) - 1).max() < 1e-12
    assert np.linalg.norm(v @ u - u * e, axis=0).max() < 1e-13 * want[0]


def test_solver_on_equal_and_zero_eigenvalues():
    for v in (np.diag([5.0] * 4 + [2.0] * 60), np.eye(40), np.zeros((5, 5)), np.diag([1.0, 0, 0, 0, 0, 0, 0, 0, 0, 0])):
        e, u = whitening.jacobi_davidson(lambda w: v @ w, len(v), 8)
        k = min(8, len(v))
        assert np.allclose(e, np.sort(np.diag(v))[::-1][:k], atol=1e-13) and np.allclose(u.T @ u, np.eye(k), atol=1e-13)


def check_whitening(rows, got):
    """Rows (vec_id, vector) that take part against the result."""
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in np.asarray(v, np.float64)] for _, v in rows], np.int64)
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    dev = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for (i, _), r in zip(rows, x)}
    k = max(r["component"] for r in got)
    assert len(got) == n * k
    white = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    w = np.array([[white[i, j] for j in range(1, k + 1)] for i, _ in rows])
    own = c @ u[:, :k] / np.sqrt(e[:k])
    assert np.abs(w * np.sign((w * own).sum(axis=0)) - own).max() < 1e-8
    for r in got:
        d = dev[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == (d if d < 2 ** 63 else None)
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(cov), rel=1e-10)
        assert r["identity_error"] < 1e-9
    return k


def test_whitening_equals_dense_solver(spark):
    x = np.random.default_rng(8).standard_normal((700, 12)) * np.arange(1, 13) + 5
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    odd = [(800, None, 0), (801, [1.0], 0), (802, [float("nan")] + [0.0] * 11, 0), (803, [None] + [0.0] * 11, 0),
           (804, [float("-inf")] + [0.0] * 11, 0), (805, [3e38] + [0.0] * 11, 0), (806, [], 0)]
    df = with_clashes(spark.createDataFrame(rows + odd, VECTORS)).withColumnRenamed("pos", "component").repartition(3)
    assert check_whitening([r[:2] for r in rows], whitening.whiten(df).collect()) == 8


def test_whitening_edge_cases(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)], VECTORS)
    assert whitening.whiten(df).count() == 0 and whitening.whiten(df.limit(0)).count() == 0
    rows = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(9)]            # one direction only
    assert check_whitening([r[:2] for r in rows], whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()) == 1
    big = [(i, [float(i) * 2e3, -1.4e3 * i * i], 0) for i in range(50)]      # some deviations beyond a long
    got = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")).collect()
    assert check_whitening([r[:2] for r in big], got) == 2
    assert any(r["deviation"] is None for r in got) and any(r["deviation"] is not None for r in got)
    tied = spark.createDataFrame([(None, [1.0, 0.0], 0), (None, [0.0, 1.0], 0), (2, [0.5, 0.5], 0)], VECTORS)
    assert whitening.whiten(tied).count() == 3
