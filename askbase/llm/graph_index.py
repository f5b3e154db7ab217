"""Approximate nearest neighbours by robust-pruned graphs, one per shard.

Equal vectors are one node that keeps its smallest ids, so a vector repeated by
a third of the rows costs a node, not a clique.  Nodes are dealt to shards of about
``SHARD_ROWS`` by the hash of their vector.  A task builds a shard's graph: nodes
enter in rounds that double the graph; a greedy beam search over what is there
proposes neighbours, robust pruning keeps those that no kept neighbour is
``ALPHA`` times nearer to, and reverse edges are pruned alike when they overflow.
Beam search then answers every query in every shard; exact double distances order
the finds, and blocks of queries are merged over the shards.

The graph rows are written once (vectors, edges, ids: under 0.5 KB a node at 64
dimensions), so a lost executor searches again without building.  A task holds one
shard and one block of queries.  The work of searching is queries x shards: with more
executor memory give larger shards.

Defined results
  * A vector that is null, zero, of another length than the usual one, or holds null
    or non-finite entries takes no part; nor does a row without ``vec_id``.
  * Rows equal in id and vector count once.  An id with several vectors is several
    candidates, none of them for its own queries, and a query for each vector.
  * Ties go to the smaller id.  No rows, or one: no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from askbase.llm.common import written
from askbase.llm.vectors import finite_rows, is_double, usual_length

#: Distinct vectors of a shard, about.
SHARD_ROWS = 4096
#: Edges a node keeps when pruned, and the most it may gather before it is pruned again.
DEGREE, FULL = 24, 32
#: Candidates held by a search while building, and while answering.
BUILD_BEAM, BEAM = 32, 128
#: Candidates expanded in one step of a search.
EXPAND = 4
#: A kept neighbour removes candidates that are this much nearer to it than to the node.
ALPHA = 1.2
#: Nodes that enter the graph in one round, at most.
ROUND = 512
#: Nodes that a search begins at: the middle one and the first to enter, so that groups far apart are all near one.
STARTS = 32
#: Queries of a block.
BLOCK = 512
#: Beam entries that are measured again in double precision, for each result asked for.
RECHECK = 3

GRAPH = "shard int, vecs binary, ids array<array<bigint>>, edges binary"


class Graph:
    """A shard's vectors, edges and search; positions stand for nodes, ``n`` for none."""

    def __init__(self, vecs: np.ndarray, edges: np.ndarray | None = None):
        self.n = len(vecs)
        # float32 arithmetic near the origin; distances change by one common factor only
        self.scale = float(np.abs(vecs).max(initial=0.0)) or 1.0
        wide = vecs / self.scale
        self.mean = wide.mean(axis=0)
        self.x = np.ascontiguousarray(wide - self.mean, dtype=np.float32)
        start = int(np.einsum("ij,ij->i", self.x, self.x).argmin())
        self.order = np.concatenate([[start], np.delete(np.arange(self.n), start)])
        self.edges = edges if edges is not None else self._build()

    def place(self, queries: np.ndarray) -> np.ndarray:
        return (queries / self.scale - self.mean).astype(np.float32)

    def search(self, q: np.ndarray, beam: int, entered: int | None = None) -> np.ndarray:
        """Greedy beam search of all rows of ``q`` (placed) at once: nodes, nearest first.
        ``entered``: how many nodes the graph has so far."""
        n, rows = self.n, len(q)
        nodes = np.full((rows, beam), n, np.int32)
        far = np.full((rows, beam), np.inf, np.float32)
        todo = np.zeros((rows, beam), bool)
        starts = self.order[:min(STARTS, beam, n if entered is None else entered)]
        begin = ((self.x[starts][None] - q[:, None]) ** 2).sum(axis=2)
        order = np.argsort(begin, axis=1, kind="stable")
        nodes[:, :len(starts)], todo[:, :len(starts)] = starts[order], True
        far[:, :len(starts)] = np.take_along_axis(begin, order, 1)
        seen = np.zeros((rows, n + 1), bool)
        seen[:, starts] = seen[:, n] = True
        seen, slot = seen.ravel(), np.empty(rows * (n + 1), np.int32)
        live = np.arange(rows)
        while len(live):
            open_ = todo[live]
            at, col = np.nonzero(open_ & (np.cumsum(open_, axis=1) <= EXPAND))
            todo[live[at], col] = False
            near = self.edges[nodes[live[at], col]]
            row, near = np.repeat(at, near.shape[1]), near.ravel()
            cell = live[row] * (n + 1) + near
            new = np.flatnonzero(~seen[cell])
            cell = cell[new]
            slot[cell] = np.arange(len(new))       # of equal cells one stays
            new = new[slot[cell] == np.arange(len(new))]
            row, near = row[new], near[new]
            seen[live[row] * (n + 1) + near] = True
            away = self.x[near] - q[live[row]]          # differences: near vectors far from the origin stay apart
            d = np.einsum("ij,ij->i", away, away)
            close = d < far[live[row], -1]
            row, near, d = row[close], near[close], d[close]
            if len(row):
                count = np.bincount(row, minlength=len(live))
                place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
                more, more_far = (np.full((len(live), count.max()), f, t) for f, t in ((n, np.int32), (np.inf, np.float32)))
                more[row, place], more_far[row, place] = near, d
                all_far = np.concatenate([far[live], more_far], axis=1)
                order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
                far[live] = np.take_along_axis(all_far, order, 1)
                nodes[live] = np.take_along_axis(np.concatenate([nodes[live], more], axis=1), order, 1)
                todo[live] = np.take_along_axis(np.concatenate([todo[live], more < n], axis=1), order, 1)
            live = live[todo[live].any(axis=1)]
        return nodes

    def _prune(self, of: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Robust pruning of each row's candidates (distinct, ``n`` for none) to ``DEGREE`` diverse edges."""
        n, rows = self.n, np.arange(len(of))
        none = (cand == n) | (cand == of[:, None])
        safe = np.where(none, 0, cand)
        x = self.x[safe] - self.x[of][:, None, :]      # around the node, where float32 tells near ones apart
        d = np.einsum("bcd,bcd->bc", x, x)
        d[none] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
        x = np.take_along_axis(x, order[:, :, None], 1)
        sq = np.einsum("bcd,bcd->bc", x, x)
        apart = np.maximum(sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1)), 0) * ALPHA ** 2
        kept, left = np.full((len(of), FULL), n, np.int32), np.isfinite(d)
        for k in range(DEGREE):
            j = left.argmax(axis=1)
            some = left[rows, j]
            if not some.any():
                break
            kept[some, k] = cand[rows, j][some]
            left &= ~((apart[rows, j] <= d) & some[:, None])
            left[rows, j] = False
        return kept

    def _build(self) -> np.ndarray:
        n = self.n
        self.edges = np.full((n, FULL), n, np.int32)
        done = 1
        while done < n:
            new = self.order[done:done + min(done, ROUND)]
            self.edges[new] = self._prune(new, self.search(self.x[new], BUILD_BEAM, done))
            done += len(new)
            src, dst = np.repeat(new, FULL), self.edges[new].ravel()
            src, dst = src[dst < n], dst[dst < n]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            to, first, count = np.unique(dst, return_index=True, return_counts=True)
            group = np.repeat(np.arange(len(to)), count)
            rank = np.arange(len(dst)) - first[group]
            have = (self.edges[to] < n).sum(axis=1)
            room = have + count <= FULL
            fits = room[group]
            self.edges[dst[fits], (have[group] + rank)[fits]] = src[fits]
            for part in np.array_split(np.flatnonzero(~room), max(1, (len(to) - room.sum()) // ROUND)):
                if len(part):
                    spot = np.full(len(to), -1)
                    spot[part] = np.arange(len(part))
                    mine = spot[group] >= 0
                    extra = np.full((len(part), count[part].max()), n, np.int32)
                    extra[spot[group[mine]], rank[mine]] = src[mine]
                    both = np.concatenate([self.edges[to[part]], extra], axis=1)
                    both.sort(axis=1)
                    both[:, 1:][both[:, 1:] == both[:, :-1]] = n
                    both.sort(axis=1)
                    self.edges[to[part]] = self._prune(to[part], both[:, :(both < n).sum(axis=1).max()])
        return self.edges


def distinct_vectors(df: DataFrame, dims: int, keep: int) -> DataFrame:
    """``key, embedding, ids``: each distinct vector that takes part, with its ``keep`` smallest ids."""
    rows = usable_rows(df, dims).dropDuplicates(["key", "vec_id"])
    # the rank limit is applied in every task before the shuffle: a hot vector sends ``keep`` rows a task
    w = Window.partitionBy("key").orderBy("vec_id")
    few = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
    return few.groupBy("key").agg(F.any_value("embedding").alias("embedding"),
                                  F.sort_array(F.collect_list("vec_id")).alias("ids"))


def usable_rows(df: DataFrame, dims: int) -> DataFrame:
    """``vec_id, embedding, key``: rows that take part, with a 128-bit hash of the vector."""
    kind = "double" if is_double(df) else "float"
    src = df.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"),
                                                       F.col("embedding").cast(f"array<{kind}>").alias("embedding"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = finite_rows(b.column("embedding"), dims)
            some = (x != 0).any(axis=1)
            at, x = at[some], x[some] + 0.0        # -0.0 is 0.0
            keys = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns), pa.array(keys, pa.binary())],
                                             names=["vec_id", "embedding", "key"])
    return src.mapInArrow(keyed, f"vec_id bigint, embedding array<{kind}>, key binary")


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _runs(batches: Iterator[pa.RecordBatch], col: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by ``col``, a table per value."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        values = b.column(col).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for i, j in zip(cuts, cuts[1:]):
            if held and held[-1].column(col)[0].as_py() != values[i]:
                yield held[-1].column(col)[0].as_py(), pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield held[-1].column(col)[0].as_py(), pa.Table.from_batches(held).combine_chunks()


def build_graphs(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """A graph per shard over written ``key, embedding, ids``, as a written table; and the number of shards."""
    n = nodes.count()
    shards = -(-n // shard_rows)
    if not shards:
        return nodes.sparkSession.createDataFrame([], GRAPH), 0
    dealt = nodes.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "embedding", "ids")
    # one or a few shards a task; their number is given, so that tasks are not merged for being small
    dealt = dealt.repartitionByRange(min(shards, 100_000), "shard").sortWithinPartitions("shard", "key")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, t in _runs(batches, "shard"):
            vecs = _matrix(t.column("embedding").combine_chunks())
            edges = Graph(vecs.astype(np.float64)).edges
            ids = t.column("ids").combine_chunks()
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([vecs.tobytes()], pa.binary()), ids,
                                              pa.array([edges.tobytes()], pa.binary())], names=["shard", "vecs", "ids", "edges"])
    return written(dealt.mapInArrow(build, GRAPH), "graphs"), shards


def _found(graph: Graph, vecs: np.ndarray, ids: list[list[int]], queries: np.ndarray, own: list[int], k: int):
    """The ``k`` nearest (score, id) of each query in one shard."""
    beam = graph.search(graph.place(queries), BEAM)[:, :RECHECK * (k + 1)]
    safe = np.minimum(beam, graph.n - 1)
    score = np.sqrt(((vecs[safe] - queries[:, None, :]) ** 2).sum(axis=2))
    score[beam == graph.n] = np.inf
    for row, s, me in zip(safe, score, own):
        best = sorted((d, ids[i][0], i) for d, i in zip(s.tolist(), row.tolist()) if d < np.inf)[:k + 1]
        yield sorted((d, c) for d, _, i in best for c in ids[i] if c != me)[:k]


def nearest(df: DataFrame, every: int = 100, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row whose id is divisible by ``every``."""
    dims, wide = usual_length(df), is_double(df)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not dims:
        return df.sparkSession.createDataFrame([], schema)
    nodes = written(distinct_vectors(df, dims, k + 1), "graph-nodes")
    graphs, shards = build_graphs(nodes, shard_rows)
    asked = usable_rows(df.filter(F.col("vec_id") % every == 0), dims).dropDuplicates(["key", "vec_id"])
    asked = written(asked, "graph-queries")
    blocks = max(1, -(-asked.count() // BLOCK))
    block = F.pmod(F.xxhash64("vec_id", "key"), F.lit(blocks)).cast("int")
    packed = asked.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("vec_id").alias("id"), F.col("embedding").alias("v")))).alias("queries"))
    packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards, 1) - 1))))
    both = graphs.withColumn("block", F.lit(-1)).unionByName(packed, allowMissingColumns=True)
    both = both.repartitionByRange(min(max(shards, 1), 100_000), "shard").sortWithinPartitions("shard", "block")
    kind = np.float64 if wide else np.float32

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = graph = vecs = ids = None
        for b in batches:
            for i in range(b.num_rows):
                shard, which = b.column("shard")[i].as_py(), b.column("block")[i].as_py()
                if which < 0:
                    vecs = np.frombuffer(b.column("vecs")[i].as_py(), kind).reshape(-1, dims).astype(np.float64)
                    graph = Graph(vecs, np.frombuffer(b.column("edges")[i].as_py(), np.int32).reshape(-1, FULL))
                    at, ids = shard, b.column("ids")[i].as_py()
                elif at == shard:        # a shard that no vector was dealt to has no graph
                    q = b.column("queries")[i].values
                    own = q.field("id").to_pylist()
                    hits = list(_found(graph, vecs, ids, _matrix(q.field("v")).astype(np.float64), own, k))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([which], pa.int32()), pa.array([own], pa.list_(pa.int64())),
                         pa.array([[[c for _, c in h] for h in hits]], pa.list_(pa.list_(pa.int64()))),
                         pa.array([[[d for d, _ in h] for h in hits]], pa.list_(pa.list_(pa.float64())))],
                        names=["block", "query", "found", "score"])

    parts = both.mapInArrow(search, "block int, query array<bigint>, found array<array<bigint>>, score array<array<double>>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block is in the same order in every shard, so queries are told apart by their place
        block, own, best = None, [], []
        def rows():
            out = [(q, r + 1, c, d) for q, hits in zip(own, best) for r, (d, c) in enumerate(hits)]
            cols = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))],
                                              names=["query_id", "rank", "vec_id", "score"])
        for b in batches:
            for i in range(b.num_rows):
                if b.column("block")[i].as_py() != block:
                    if block is not None:
                        yield rows()
                    block, own = b.column("block")[i].as_py(), b.column("query")[i].as_py()
                    best = [[] for _ in own]
                for j, (f, s) in enumerate(zip(b.column("found")[i].as_py(), b.column("score")[i].as_py())):
                    best[j] = sorted(best[j] + list(zip(s, f)))[:k]
        if block is not None:
            yield rows()

    parts = written(parts, "graph-found")
    return parts.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(merge, schema)
