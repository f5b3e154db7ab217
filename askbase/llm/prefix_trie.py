"""Conversation prefix trie by depth bands.

Every conversation is a path of turns from a textless root; conversations that
begin alike share nodes.  A node is named by its depth and a 128-bit hash of
its turns: the xor of one hash per (depth, role, text), so the name of any
prefix is a running xor and needs no walk along the conversation.

Totals over subtrees go by *depth bands* of ``BAND`` levels.  A node is exploded
only to its ancestors inside its own band (``BAND`` rows at most), which gives
totals within the band.  The band roots then form a tree that is ``BAND`` times
lower; the same step on that tree completes their totals (log of the depth in
rounds, not one per band), and every completed root is added once to the
ancestors in the band above it.

No step holds a conversation, a node's members or a band level in one task: turns
are numbered by ``group_rank``, running xors are local to (conversation, band)
with a carry per range partition, members are counted by partial aggregates, and
the hash over a node's members reads them as sorted blocks, one at a time.

Defined results
  * null ``conv_id``: the row belongs to no conversation; null role or text is ''.
  * null ``turn`` comes first; equal turns go by role, then by the MD5 of the text
    (repeated rows stay as turns of their own).
  * ``c % 5`` has the sign of ``c``, as in SQL.
  * no conversation: no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from askbase.llm.common import sized, written
from askbase.operators.indexing import group_rank

#: Levels of a band: the most rows that a node is exploded to.
BAND = 16
#: Ids in one block of a node's members.
BLOCK_IDS = 4096
KEY = ["depth", "k1", "k2"]


def borrow_heads(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Rebuilt conversations: ``conv_id, pos, role, digest, n_bytes`` from ranked
    turns (``pos`` from 0), and one row with ``pos`` = -1 per conversation.

    Conversation c takes its first h = crc32(decimal c) % ``most`` turns from
    conversation c - c % ``every`` (all of them if fewer) and goes on with its own
    turns after its first h.
    """
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).withColumn(
        "base", F.col("conv_id") - F.col("conv_id") % every)
    lens = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(lens, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "head"), "trie-convs")
    heads = convs.select(F.col("conv_id").alias("c"), "base", "h")
    borrowed = turns.filter((F.col("pos") < most) & (F.col("conv_id") % every == 0)).join(
        heads, (F.col("conv_id") == F.col("base")) & (F.col("pos") < F.col("h")))
    own = turns.join(sized(convs.select("conv_id", "h", "head"), 96), "conv_id").filter(F.col("pos") >= F.col("h"))
    cols = ["role", "digest", "n_bytes"]
    root = convs.select("conv_id", F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("role"),
                        F.lit("").alias("digest"), F.lit(0).cast("bigint").alias("n_bytes"))
    return (own.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), *cols)
            .unionByName(borrowed.select(F.col("c").alias("conv_id"), "pos", *cols)).unionByName(root))


def _carries(totals: DataFrame) -> DataFrame:
    """Xor of all earlier bands of a conversation: ``conv_id, band, c1, c2``.

    Bands are sorted over range partitions; a partition's first conversation takes
    over what earlier partitions hold of it (one row per partition on the driver).
    """
    spark = totals.sparkSession
    s = totals.repartitionByRange("conv_id", "band").sortWithinPartitions("conv_id", "band")
    s = written(s.withColumn("_pid", F.spark_partition_id()), "trie-bands")
    w = Window.partitionBy("_pid", "conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    local = s.withColumn("c1", F.coalesce(F.bit_xor("t1").over(w), F.lit(0))).withColumn(
        "c2", F.coalesce(F.bit_xor("t2").over(w), F.lit(0)))
    at = F.struct("conv_id", "band")
    ends = local.groupBy("_pid").agg(F.min("conv_id").alias("first"), F.max_by(F.struct(
        "conv_id", (F.col("c1").bitwiseXOR(F.col("t1"))).alias("x1"), (F.col("c2").bitwiseXOR(F.col("t2"))).alias("x2")),
        at).alias("last")).collect()
    rows, prev = [], (None, 0, 0)
    for r in sorted(ends, key=lambda r: r["_pid"]):
        if prev[0] == r["first"]:
            rows.append((r["_pid"], r["first"], prev[1], prev[2]))
        last, more = r["last"], prev[0] == r["first"] == r["last"]["conv_id"]
        prev = (last["conv_id"], last["x1"] ^ (prev[1] if more else 0), last["x2"] ^ (prev[2] if more else 0))
    over = spark.createDataFrame(rows, "_pid int, conv_id bigint, o1 bigint, o2 bigint")
    out = local.join(F.broadcast(over), ["_pid", "conv_id"], "left")
    return out.select("conv_id", "band", *[F.col(c).bitwiseXOR(F.coalesce(o, F.lit(0))).alias(c)
                                           for c, o in (("c1", "o1"), ("c2", "o2"))])


def _in_bands():
    return Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """A row per conversation and depth: its node's key, its parent's key, the keys
    of its ancestors within the band (itself last) and the bytes of the last text."""
    def h(seed):
        return F.when(F.col("pos") < 0, F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "pos", "role", "digest"))
    x = rebuilt.select("conv_id", (F.col("pos") + 1).alias("depth"), "n_bytes", h(1).alias("a1"), h(2).alias("a2"))
    x = x.withColumn("band", F.floor(F.col("depth") / BAND).cast("bigint"))
    w = _in_bands()
    local = x.withColumn("l1", F.bit_xor("a1").over(w)).withColumn("l2", F.bit_xor("a2").over(w))
    local = local.withColumn("anc1", F.collect_list("l1").over(w)).withColumn("anc2", F.collect_list("l2").over(w))
    local = written(local, "trie-local")
    # only conversations that reach a second band have anything to carry
    totals = local.groupBy("conv_id", "band").agg(F.bit_xor("a1").alias("t1"), F.bit_xor("a2").alias("t2"))
    long = local.filter(F.col("band") > 0).select("conv_id").distinct()
    carry = written(_carries(totals.join(long, "conv_id", "left_semi")), "trie-carry")
    y = local.join(sized(carry.filter(F.col("band") > 0), 96), ["conv_id", "band"], "left")
    for i in "12":
        c = F.coalesce(f"c{i}", F.lit(0))
        y = y.withColumn(f"k{i}", F.col(f"l{i}").bitwiseXOR(c)).withColumn(
            f"anc{i}", F.when(F.col(f"c{i}").isNull(), F.col(f"anc{i}")).otherwise(
                F.expr(f"transform(anc{i}, v -> v ^ c{i})")))
        y = y.withColumn(f"p{i}", F.col(f"k{i}").bitwiseXOR(F.col(f"a{i}")))
    return y.select("conv_id", *KEY, "p1", "p2", "anc1", "anc2", "n_bytes")


def _to_ancestors(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``values`` of every node added up at each of its ancestors within the band, itself included."""
    first = F.col("depth") - F.size("anc1") + 1
    x = nodes.select(*values, first.alias("_first"), F.posexplode(F.arrays_zip("anc1", "anc2")).alias("_i", "_a"))
    return x.groupBy((F.col("_first") + F.col("_i")).alias("depth"), F.col("_a.anc1").alias("k1"),
                     F.col("_a.anc2").alias("k2")).agg(*[F.sum(v).alias(v) for v in values])


def rollup(nodes: DataFrame, rows: DataFrame, deepest: int, values: list[str]) -> DataFrame:
    """``values`` summed over each node's whole subtree, per ``depth, k1, k2``.

    ``nodes``: key, parent's key ``p1, p2``, ``anc1, anc2`` and values; ``rows``:
    ``conv_id`` and key, a row per conversation and depth.
    """
    inside = _to_ancestors(nodes, values)
    if deepest < BAND:
        return inside
    inside = written(inside, "trie-inside")
    # the band roots, a tree of its own
    at = rows.filter(F.col("depth") % BAND == 0).select(
        "conv_id", (F.col("depth") / BAND).cast("bigint").alias("depth"), "k1", "k2")
    up = at.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    # conversations without a second band hold the root only; one of them is as good as all
    deep = at.filter(F.col("depth") > 0).select("conv_id").distinct()
    at = written(at.join(deep, "conv_id", "left_semi").join(up, ["conv_id", "depth"], "left").withColumn(
        "band", F.floor(F.col("depth") / BAND).cast("bigint")), "trie-roots")
    w = _in_bands()
    roots = at.withColumn("anc1", F.collect_list("k1").over(w)).withColumn("anc2", F.collect_list("k2").over(w))
    roots = roots.groupBy(*KEY).agg(*[F.any_value(c).alias(c) for c in ("p1", "p2", "anc1", "anc2")])
    of_roots = inside.filter(F.col("depth") % BAND == 0).withColumn("depth", (F.col("depth") / BAND).cast("bigint"))
    whole = written(rollup(written(roots.join(of_roots, KEY), "trie-level"), at.select("conv_id", *KEY),
                           deepest // BAND, values), "trie-whole")
    # every completed root once to its parent, and from there through the band above
    below = whole.filter(F.col("depth") > 0).withColumn("depth", F.col("depth") * BAND)
    links = nodes.select(*KEY, "p1", "p2").filter((F.col("depth") % BAND == 0) & (F.col("depth") > 0))
    last = below.join(links, KEY).groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"),
                                          F.col("p2").alias("k2")).agg(*[F.sum(v).alias(v) for v in values])
    lasts = nodes.select(*KEY, "anc1", "anc2").filter(F.col("depth") % BAND == BAND - 1)
    both = inside.unionByName(_to_ancestors(lasts.join(last, KEY), values))
    return both.groupBy(*KEY).agg(*[F.sum(v).alias(v) for v in values])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) rows to runs of at most ``BLOCK_IDS`` ids of one node."""
    key, ids = None, []

    def block():
        return pa.RecordBatch.from_pylist([{"depth": key[0], "k1": key[1], "k2": key[2], "start": ids[0],
                                            "ids": ",".join(map(str, ids))}], schema=_BLOCK)
    out = []
    for b in batches:
        for d, k1, k2, c in zip(*(b.column(n).to_pylist() for n in ("depth", "k1", "k2", "conv_id"))):
            if ids and ((d, k1, k2) != key or len(ids) == BLOCK_IDS):
                out.append(block())
                ids = []
            key = (d, k1, k2)
            ids.append(c)
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if ids:
        yield block()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks to one SHA-256 per node, a block in memory at a time."""
    key, state = None, None
    for b in batches:
        done = []
        for d, k1, k2, ids in zip(*(b.column(n).to_pylist() for n in ("depth", "k1", "k2", "ids"))):
            if (d, k1, k2) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (d, k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _DIGEST.types)], schema=_DIGEST)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, (*key, state.hexdigest())))], schema=_DIGEST)


_BLOCK = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("ids", pa.string())])
_DIGEST = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 over each node's ``conv_id`` in ascending order, comma-joined.

    A hash over one list is serial by nature; a hot node's task reads it as blocks
    that many tasks have sorted and joined, and holds one block.
    """
    ends = written(ends.select(*KEY, "conv_id"), "trie-ends")
    by = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    blocks = by.mapInArrow(_blocks, "depth bigint, k1 bigint, k2 bigint, start bigint, ids string")
    blocks = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "start")
    return blocks.mapInArrow(_digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def rank_turns(conversations: DataFrame) -> DataFrame:
    """Turns of each conversation numbered from 0; texts as MD5 and UTF-8 length."""
    text = F.coalesce("text", F.lit(""))
    t = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.md5(text.cast("binary")).alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return group_rank(t, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "pos")


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """A row per node of the trie over ``conv_id, pos, role, digest, n_bytes`` (see ``borrow_heads``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    rows = written(prefixes(rebuilt), "trie-rows")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                   *[F.any_value(c).alias(c) for c in ("p1", "p2", "anc1", "anc2", "n_bytes")])
    nodes = written(nodes, "trie-nodes")
    born = nodes.filter(F.col("depth") > 0).groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"),
                                                    F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(born, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("bigint")).withColumn(
        "saved_tokens", (F.col("n_convs") - 1) * F.col("n_bytes"))
    nodes = written(nodes, "trie-valued")
    values = ["n_leaves", "saved_tokens"]
    whole = rollup(nodes, rows.select("conv_id", *KEY), deepest, values)
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("e")).select("conv_id", "e.*")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop(*values).join(whole, KEY).join(ends_digest(last), KEY, "left")
    out = out.join(parents, ["depth", "p1", "p2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *values,
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
