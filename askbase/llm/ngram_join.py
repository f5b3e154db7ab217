"""N-gram Jaccard join (operator 2): blocked sparse product of document by n-gram incidence.

Documents link when ``per * |A & B| >= need * |A | B|`` for their sets of
distinct word n-grams (hashed to 64 bits).  The result names, per document,
the smallest id that links reach.

1. *Classes*: documents with equal sets are one class (128-bit hash of the set).
2. *Blocks*: a size-derived bound, made into a filter that loses no link.
   Two linked sets of sizes x, y differ in at most
   d = (x + y) (per - need) / (per + need) n-grams.  N-grams are dealt by hash
   into m > d parts, so at least m - d parts are equal in both.  A
   signature is the hash of k = m - d parts taken together (of every such
   choice while m is small, else of single parts); linked sets share a
   signature.  Of single parts a set signs with its d + 1 largest: the largest
   of the m - d equal ones has m - d - 1 smaller ones in either set, so it is among
   them.  m follows from a size level; a set also signs for the next
   level if its size can link up there.  Sets that share a signature are compared by
   a parity sketch of about a bit per n-gram: every n-gram flips one bit, so sketches of linked
   sets differ in at most d bits, and unrelated ones in nearly half of all.  What is
   alike in that sense is put in one block (components), so no link is lost and
   blocks are hardly larger than the result's components.  Of signatures with the same holders one
   is looked at; one with over ``block_sets`` holders is cut into tiles as blocks are.
3. *Product*: per block the incidence rows of its classes are multiplied,
   overlap counts are accumulated n-gram by n-gram, and pairs below the
   size-derived overlap bound are discarded.  Only a forest of links leaves the
   task: rows already reached are not multiplied again.  A block over
   ``block_sets`` sets or ``block_grams`` n-grams (32 MB) is cut into tiles, and every
   pair of tiles is a task of its own; most blocks are one tile, and n-grams are
   shuffled once for them.
4. *Components* of the links over classes, then membership of the documents.

Words are runs outside ASCII white space after A-Z are lower-cased; a text
with fewer words than ``n`` is one n-gram.  Null, empty or blank texts have an
empty set and link with nothing.  Rows with a null doc_id keep their size, get
a null component and link nothing.  Repeated rows give a row each; an id with several
texts has the links of all of them.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from askbase.llm.common import sized, written
from askbase.llm.components import connected

N, NEED, PER = 3, 90, 100
GROWTH = 1.4                     # sizes of a level span this factor
BLOCK_SETS, BLOCK_GRAMS = 1 << 14, 1 << 22
MAX_CHOICES = 24
CACHE_WORDS = 150_000
_UPPER, _BLANKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[\x20\x09-\x0D]+"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
SKETCH_BITS = 1 << 6, 1 << 16
SIGNED = "doc_id long, n long, hi long, lo long, sketch binary, signatures array<long>"
SETS = "block long, doc_id long, hi long, lo long, grams array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M3
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        m = len(h) - self.n + 1
        if m <= 0:
            whole = np.array([len(h)], np.uint64)
            for k in range(len(h)):
                whole = _mix(whole * _M2 + h[k:k + 1])
            return whole
        out = np.zeros(m, np.uint64)
        for k in range(self.n):
            out = _mix(out * _M2 + h[k:k + m])
        return np.unique(out)


class Levels:
    """Sizes by level, and the parts that a level deals n-grams into."""

    def __init__(self, need: int, per: int):
        self.need, self.per = need, per
        self.tops: list[int] = [1]
        self._parts: dict[int, tuple[int, int]] = {}

    def _until(self, size: int) -> None:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * GROWTH)))

    def differ(self, x: int, y: int) -> int:
        """N-grams in which linked sets of these sizes may differ at most."""
        return (x + y) * (self.per - self.need) // (self.per + self.need)

    def partner(self, size: int) -> int:
        """The largest size that can link with ``size``."""
        return size * self.per // self.need

    def of(self, size: int) -> list[int]:
        """Levels in which a set of this size signs."""
        self._until(self.partner(size))
        low = int(np.searchsorted(self.tops, size))
        high = int(np.searchsorted(self.tops, self.partner(size)))
        return list(range(low, high + 1))

    def parts(self, level: int) -> tuple[int, int]:
        """(m, k): parts, and how many a signature takes together."""
        if level not in self._parts:
            d = self.differ(self.tops[level], self.tops[level])
            best = (d + 1 + max(1, d // 4), 1)   # more parts than needed, so that the smallest can be left out
            share = 1 / (d + 2)      # of the n-grams that a signature sees; more is more selective
            for m in range(d + 1, d + 9):
                k = m - d
                if comb(m, k) <= MAX_CHOICES and k / m > share:
                    best, share = (m, k), k / m
            self._parts[level] = best
        return self._parts[level]

    @staticmethod
    @cache
    def choices(m: int, k: int) -> np.ndarray:
        return np.array(list(combinations(range(m), k)))


def signatures(grams: np.ndarray, levels: Levels) -> np.ndarray:
    """Hashes of which linked sets share at least one."""
    out = []
    for level in levels.of(len(grams)):
        m, k = levels.parts(level)
        part = (_mix(grams ^ np.uint64(level * 2 + 1)) >> np.uint64(11)) % np.uint64(m)
        part = part.astype(np.int64)
        digest = np.zeros(m, np.uint64)
        np.add.at(digest, part, _mix(grams + np.uint64(level)))     # order-free, of distinct n-grams
        salt = np.full(1, level, np.uint64) * _M1
        digest = _mix(digest + np.arange(1, m + 1, dtype=np.uint64) * _M2 + salt)
        if k > 1:
            out.append(_mix(digest[levels.choices(m, k)].sum(axis=1, dtype=np.uint64) * _M2 + salt))
            continue
        # small parts are those that unrelated sets share; equal parts rank alike in both sets
        held = np.bincount(part, minlength=m)
        top = levels.tops[level]
        out.append(digest[np.lexsort((digest, held))[m - levels.differ(top, top) - 1:]])
    return np.unique(np.concatenate(out))


def sketch_of(grams: np.ndarray) -> bytes:
    """Parities of the n-grams dealt over a power of two of bits, at least one bit per n-gram (up to a bound)."""
    low, high = SKETCH_BITS
    bits = min(max(low, 1 << (len(grams) - 1).bit_length()), high)
    at = (_mix(grams ^ _M2) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def _set_hash(grams: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(grams.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def sign(docs: DataFrame, n: int, need: int, per: int) -> DataFrame:
    def run(batches):
        shingle, levels = Shingler(n), Levels(need, per)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                ids, size, hi, lo, sketch, sigs = part.column(0).to_pylist(), [], [], [], [], []
                for doc_id, text in zip(ids, part.column(1).to_pylist()):
                    g = shingle(text)
                    size.append(len(g))
                    a, z = _set_hash(g) if len(g) else (0, 0)
                    hi.append(a)
                    lo.append(z)
                    signs = len(g) and doc_id is not None
                    sketch.append(sketch_of(g) if signs else None)
                    sigs.append(signatures(g, levels).view(np.int64) if signs else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(hi, pa.int64()),
                     pa.array(lo, pa.int64()), pa.array(sketch, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "hi", "lo", "sketch", "signatures"])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def alike(size: np.ndarray, sketches: list[bytes], need: int, per: int) -> list[tuple[int, int]]:
    """A forest of the pairs of rows whose sketches differ in no more bits than linked sets may."""
    width = min(map(len, sketches))
    rows = np.empty((len(sketches), width), np.uint8)
    for i, raw in enumerate(sketches):
        bits = np.frombuffer(raw, np.uint8)
        while len(bits) > width:           # as if dealt over half as many bits
            bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
        rows[i] = bits
    rows = rows.view(np.uint64)
    left, links, queue = np.arange(1, len(rows)), [], [0]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        i = queue.pop()
        may = (size[left] + size[i]) * (per - need) // (per + need)
        ok = np.abs(size[left] - size[i]) <= may
        ok[ok] = np.bitwise_count(rows[left[ok]] ^ rows[i]).sum(axis=1, dtype=np.int64) <= may[ok]
        for j in left[ok].tolist():
            links.append((i, j))
            queue.append(j)
        left = left[~ok]
    return links


def _alike(need: int, per: int):
    """Links of sets that are alike, for rows sorted by signature and tiles."""
    def forest(b):
        """Links of the groups of ``b``; its last group, which may go on, is left."""
        keys = np.stack([b.column(c).to_numpy() for c in ("sig", "t1", "t2")])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        hi, n, sketch = b.column("hi").to_numpy(), b.column("n").to_numpy(), b.column("sketch").to_pylist()
        out = []
        for i, j in zip(starts, [*starts[1:], b.num_rows]):
            if j - i > 1 and j < b.num_rows:
                out += [(hi[i + x], hi[i + y]) for x, y in alike(n[i:j], sketch[i:j], need, per)]
        return out, int(starts[-1])

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            rest = b if rest is None else pa.concat_batches([rest, b])
            out, at = forest(rest)
            rest = rest.slice(at)
            yield _pairs(out)
        if rest is not None and rest.num_rows > 1:
            hi = rest.column("hi").to_numpy()
            links = alike(rest.column("n").to_numpy(), rest.column("sketch").to_pylist(), need, per)
            yield _pairs([(hi[x], hi[y]) for x, y in links])

    return run


def _pairs(links: list) -> pa.RecordBatch:
    t = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(t.max(axis=1), pa.int64()), pa.array(t.min(axis=1), pa.int64())], names=["a", "b"])


def _tiled(rows: DataFrame, tiles: Column, by: str) -> DataFrame:
    """``rows`` with (tiles, t1, t2): a task per pair of tiles; tiles of one are the group itself."""
    rows = rows.withColumn("tiles", F.ceil(tiles).cast("int")).withColumn("tile", F.pmod(F.xxhash64(by), F.col("tiles")).cast("int"))
    other = F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumn("other", other)
    rows = rows.withColumn("t1", F.least("tile", "other")).withColumn("t2", F.greatest("tile", "other"))
    return rows.filter("tiles = 1 or t1 <> t2").drop("tile", "other")


def _blocks(signed: DataFrame, classes: DataFrame, need: int, per: int, block_sets: int) -> DataFrame:
    """(hi, lo, rep, block, sets, grams): classes with others that are alike and share a signature."""
    posted = signed.select(F.explode("signatures").alias("sig"), "hi")
    shared = posted.groupBy("sig").agg(F.min("hi").alias("hub"), F.max("hi").alias("far")).filter("hub <> far")
    shared = written(shared.select("sig"), "shared")
    held = written(posted.join(sized(shared, 16), "sig").distinct(), "held")
    # signatures with the same holders: one of them asks for all
    holders = held.groupBy("sig").agg(F.count(F.lit(1)).alias("sets"), *[
        F.bit_xor(F.xxhash64(F.lit(k), "hi")).alias(f"x{k}") for k in (1, 2)])
    asked = written(holders.groupBy("sets", "x1", "x2").agg(F.min("sig").alias("sig")).select("sig", "sets"), "asked")
    sketches = signed.filter("sketch is not null").groupBy("hi").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    rows = _tiled(held.join(sized(asked, 24), "sig"), F.col("sets") / block_sets, "hi").select("sig", "t1", "t2", "hi")
    rows = rows.join(sketches, "hi").repartition("sig", "t1", "t2").sortWithinPartitions("sig", "t1", "t2")
    edges = rows.mapInArrow(_alike(need, per), "a long, b long")
    label = connected(written(edges, "alike")).select(F.col("node").alias("hi"), F.col("component").alias("block"))
    members = classes.join(label, "hi")
    size = members.groupBy("block").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams"))
    return members.join(size, "block").select("hi", "lo", "rep", "block", "sets", "grams")


def overlaps(grams: list[np.ndarray], need: int, per: int, split: int | None = None) -> list[tuple[int, int]]:
    """A forest of the linked pairs of rows; with ``split`` links of rows before
    and after it only matter (and all others may be given as well)."""
    size = np.array([len(g) for g in grams])
    vocab, token = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.repeat(np.arange(len(grams)), size)
    at = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(token, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(vocab)))])
    columns = row[order]                     # rows by n-gram: the transpose
    left = np.ones(len(grams), bool)
    links = []
    for root in range(len(grams)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            if not left.any():
                break
            t = token[at[i]:at[i + 1]]
            lo, hi = first[t], first[t + 1]
            shared = hi - lo > 1
            lo, n = lo[shared], (hi - lo)[shared]
            if not len(n):
                continue
            # all rows that hold any of its n-grams, once per n-gram
            pick = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            count = np.bincount(columns[pick], minlength=len(grams))
            both = size + size[i]
            ok = left & (count * (need + per) >= need * both) & (count > 0)
            for j in np.flatnonzero(ok):
                links.append((i, int(j)))
                queue.append(int(j))
            left &= ~ok
    return links


def _multiply(need: int, per: int):
    def run(group):
        t = group.combine_chunks()
        ids, lists = t.column("doc_id").to_numpy(), t.column("grams").combine_chunks()
        at = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        grams = [flat[i:j] for i, j in zip(at, at[1:])]
        links = np.array(overlaps(grams, need, per) if len(grams) > 1 else [], np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(ids[links[:, 0]], pa.int64()), pa.array(ids[links[:, 1]], pa.int64())], names=["a", "b"])

    return run


def _links(docs: DataFrame, blocks: DataFrame, n: int, need: int, per: int, block_sets: int,
           block_grams: int) -> DataFrame:
    def fetch(batches):
        shingle, sent = Shingler(n), set()
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                grams = [shingle(t) for t in part.column(1).to_pylist()]
                # a repeated id can have other texts: the class's own count; and of equal rows one a task is enough
                own, keep = zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()), []
                for i, (doc_id, hi, lo) in enumerate(own):
                    if len(grams[i]) and (hi, lo) == _set_hash(grams[i]) and (doc_id, hi, lo) not in sent:
                        sent.add((doc_id, hi, lo))
                        keep.append(i)
                out = part.drop_columns(["text", "hi", "lo"]).take(pa.array(keep, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array([grams[i].view(np.int64) for i in keep], pa.list_(pa.int64()))],
                    names=[*out.schema.names, "grams"])

    wanted = blocks.select(F.col("rep").alias("doc_id"), "hi", "lo", "block", "sets", F.col("grams").alias("total"))
    rows = docs.select("doc_id", "text").join(sized(wanted, 80), "doc_id").select(
        "doc_id", "text", "hi", "lo", "block", "sets", "total")
    rows = rows.mapInArrow(fetch, "doc_id long, block long, sets long, total long, grams array<long>")
    rows = _tiled(rows, F.greatest(F.col("sets") / block_sets, F.col("total") / block_grams), "doc_id")
    rows = rows.select("block", "t1", "t2", "doc_id", "grams")
    return rows.groupBy("block", "t1", "t2").applyInArrow(_multiply(need, per), "a long, b long")


def jaccard_components(docs: DataFrame, n: int = N, need: int = NEED, per: int = PER, block_sets: int = BLOCK_SETS,
                       block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    signed = written(sign(docs, n, need, per), "signed")
    named = signed.filter("n > 0 and doc_id is not null")
    classes = named.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    blocks = written(_blocks(signed, classes, need, per, block_sets), "blocks")
    links = written(_links(docs, blocks, n, need, per, block_sets, block_grams), "links")
    label = connected(links).select(F.col("node").alias("rep"), "component")
    named_class = classes.select("hi", "lo", "rep").join(label, "rep", "left").select(
        "hi", "lo", F.coalesce("component", "rep").alias("component"))
    sizes = signed.select("doc_id", "n", "hi", "lo")
    linked = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return sizes.join(named_class, ["hi", "lo"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document per component: the one whose id names it.

    Of several rows with that id one stays (the smallest text); rows without an id stay
    apart from all others, one of each sequence of words.
    """
    found = jaccard_components(docs, **options)
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(sized(gone, 16), "doc_id", "left_anti").select(*docs.columns)
    often = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    often = sized(written(often, "repeated"), 16)
    first = F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNull(), "text")).alias("_row")
    once = left.join(often, "doc_id", "left_semi").select(*docs.columns).groupBy("doc_id").agg(first).select("_row.*")
    words = F.split(F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower()), _BLANKS, " ")), " ")
    bare = left.filter("doc_id is null").groupBy(F.xxhash64(F.lit(1), words).alias("_a"), F.xxhash64(F.lit(2), words).alias("_b")).agg(
        first).select("_row.*")
    rest = left.filter("doc_id is not null").join(often, "doc_id", "left_anti").select(*docs.columns)
    return rest.unionByName(once).unionByName(bare)
