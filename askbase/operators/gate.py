"""The fuzzy match gate (M1-M5).

Question: does *any* knowledge-base pattern reach the token-sort threshold?

Plan shape, chosen for very many questions against a bounded pattern set:

1. Both sides are reduced to distinct T2 keys (partial+final aggregation, so
   a key that holds a third of all questions costs one row after the
   map-side combine).
2. The pattern side carries its per-key features (length, character bag,
   LCS bitmasks) computed once.  Under the broadcast budget (its bytes are
   measured) it is broadcast and a **left-semi** join tests each question key;
   the condition is ordered cheap-to-expensive (equality, length bound, bag
   bound, exact LCS score), and the semi join stops at the first hit.  Both
   bounds are >= the LCS score, so pruning never loses a match (M4).
3. Over the budget the loop of the reference is kept, with its early exit: at thresholds
   this low a question passes *some* pattern soon if there are many.  Slices of the patterns
   that grow are tried in turn, and only the keys that no slice has passed go on
   (``SLICES``; the last slice is the rest).  In a slice every chunk of keys meets every block of
   patterns in a group of its own, where the recurrence of M1 runs over arrays: a pair costs some
   100 ns, where the same fold as an expression took 100 times that, and nothing is broadcast.
   Candidate pairs and the exact mode use an equi-join on blocking keys that lose no match: a pair that reaches
   the threshold shares at least a known number of (character, occurrence) tokens, so the
   *prefixes* of both sides share a token, in an order of all tokens by how
   few pattern keys hold them (measured); and the lengths of such a pair lie in neighbouring
   length bands.  The keys are (token, band); a pair is tested under the first
   token that its prefixes share, so once.
4. The verdict per key is joined back to the questions (AQE splits a hot key).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from askbase.functions import similarity as S
from askbase.functions.text import token_sort_key
from askbase.operators.indexing import dense_index
from askbase.operators.sizing import sized_broadcast
from askbase.session import scratch_path

# Pattern-side broadcast budget; a cluster can raise it per session.
BROADCAST_CONF = "askbase.gate.broadcastBytes"
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


# Ratio of the upper to the lower end of a length band of the blocked join.
BAND = 1.5
# Patterns that are tried one after the other, slice by slice: where each ends; the last slice is the rest.
SLICES = (64, 512, 4096, 16384)
# Keys and patterns in a group that is tested at once.
KEY_CHUNK, PATTERN_BLOCK = 512, 2048


@dataclass
class PatternIndex:
    df: DataFrame          # pkey, plen, pnw, pmasks, pinit, pbag, first_pos, first_pattern[, rank]
    broadcast: bool        # small enough to broadcast; else slices, or the blocked join
    rarity: DataFrame | None = None      # token -> order, over the budget

    def ranked(self) -> DataFrame:
        """The patterns with ``rank`` in document order, written once."""
        if "rank" not in self.df.columns:
            spark = self.df.sparkSession
            path = scratch_path(spark, "patterns")
            dense_index(self.df, [F.col("first_pos"), F.col("pkey")], "rank").write.parquet(path)
            self.df = spark.read.parquet(path)
        return self.df

    def sliced(self) -> PatternIndex:
        """Ranked, and with the order of tokens by rarity, written once."""
        if self.rarity is None:
            spark = self.df.sparkSession
            self.ranked()
            tokens = self.df.select(F.explode(_tokens("pbag")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
            path = scratch_path(spark, "tokens")
            dense_index(tokens, [F.col("n"), F.col("t")], "ord").select("t", F.col("ord").cast("int").alias("ord")).write.parquet(path)
            self.rarity = spark.read.parquet(path)
        return self


def question_features(keys: DataFrame, key_col: str = "qkey") -> DataFrame:
    """Per distinct question key: length, characters, character bag."""
    k = keys.select(F.col(key_col).alias("qkey"))
    return k.select("qkey", F.length("qkey").alias("qlen"), S.chars_of("qkey").alias("qchars"),
                    S.char_bag("qkey").alias("qbag"))


def key_features(keys: DataFrame) -> DataFrame:
    """Per distinct pattern key: length, LCS bitmasks, initial vector, bag."""
    nw, masks, init = S.pattern_bitmasks("pkey")
    return keys.select("*", F.length("pkey").alias("plen"), nw.alias("pnw"), masks.alias("pmasks"),
                       init.alias("pinit"), S.char_bag("pkey").alias("pbag"))


def pattern_features(intents: DataFrame) -> DataFrame:
    """Distinct pattern keys with everything the gate needs, plus the first
    document position and raw pattern holding that key (for M5).  Taken from the
    intents (patterns of those with a response), not from the patterns x
    responses rows."""
    p = intents.filter(F.size("responses") > 0).select(
        "intent_pos", F.posexplode("patterns").alias("pattern_pos", "Pattern"))
    p = p.select(token_sort_key(F.lower("Pattern")).alias("pkey"),
                 F.struct("intent_pos", "pattern_pos").alias("pos"), "Pattern").filter(F.col("pkey").isNotNull())
    g = p.groupBy("pkey").agg(F.min_by(F.struct("pos", "Pattern"), "pos").alias("first"))
    return key_features(g.select("pkey", F.col("first.pos").alias("first_pos"),
                                 F.col("first.Pattern").alias("first_pattern")))


def size_index(feats: DataFrame, max_bytes: int | None = None) -> PatternIndex:
    """Measure a pattern-feature table and decide broadcast vs. blocked join.

    One small aggregate job estimates its bytes (key text, bitmask words, bag entries).
    """
    spark = feats.sparkSession
    if max_bytes is None:
        max_bytes = int(spark.conf.get(BROADCAST_CONF, str(DEFAULT_BROADCAST_BYTES)))
    est = feats.select(F.sum(
        F.col("plen") * 4 + 64
        + F.size("pmasks") * (F.col("pnw") * 8 + 24)
        + F.size("pbag") * 24).alias("b")).first()["b"] or 0
    return PatternIndex(feats, est <= max_bytes)


def build_pattern_index(intents: DataFrame, max_bytes: int | None = None, persist: bool = True) -> PatternIndex:
    """The gate's pattern side from the intents, sized for broadcast.
    The features are persisted (one row per distinct pattern key), so every
    question batch reuses the bitmasks instead of rebuilding them."""
    feats = pattern_features(intents)
    if persist:
        from pyspark import StorageLevel
        feats = feats.persist(StorageLevel.MEMORY_AND_DISK)
    return size_index(feats, max_bytes)


def _pair_cond(threshold: int, bounds: bool = True) -> Column:
    t = F.lit(int(threshold))
    score = S.indel_score("qkey", "qlen", "qchars", "pkey", "plen", "pnw", "pmasks", "pinit")
    if not bounds:
        return score >= t
    return ((F.col("qkey") == F.col("pkey"))
            | ((S.length_bound("qlen", "plen") >= t)
               & (S.bag_bound("qbag", "qlen", "pbag", "plen") >= t)
               & (score >= t)))


def _bound_cond(threshold: int) -> Column:
    t = F.lit(int(threshold))
    return (S.length_bound("qlen", "plen") >= t) & (S.bag_bound("qbag", "qlen", "pbag", "plen") >= t)


def _least_share(threshold: int) -> float:
    """k: a pair reaching the threshold t has 200 * common / (a + b) >= t - 0.5, and
    common <= b, so common >= k * a; likewise with b, so both lengths are within 1 / k."""
    r = (max(int(threshold), 1) - 0.5) / 200
    return r / (1 - r)


def _tokens(bag: str) -> Column:
    """Tokens (character, occurrence) of a key; the empty key has one of its own."""
    t = F.flatten(F.transform(F.map_entries(bag), lambda e: F.transform(
        F.sequence(F.lit(1), e["value"]), lambda o: F.concat(e["key"], o.cast("string")))))
    return F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("")))


def _prefixed(keys: DataFrame, key: str, bag: str, length: str, rarity: DataFrame, threshold: int, out: str) -> DataFrame:
    """``keys`` with the prefix of each key in ``out``: its rarest tokens, one more than may be
    missing from a pair that reaches the threshold.  A token that no pattern has comes first."""
    t = keys.select(key, length, F.explode(_tokens(bag)).alias("t")).join(sized_broadcast(rarity), "t", "left")
    least = F.greatest(F.lit(1), F.ceil(F.col(length) * _least_share(threshold) - 1e-9))
    t = t.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("ord", F.lit(-1)).alias("o"), "t"))).alias("_s"),
                           F.first(length).alias(length))
    t = t.select(key, F.slice(F.transform("_s", lambda x: x["t"]), 1,
                              F.greatest(F.lit(1), F.col(length) - least + 1).cast("int")).alias(out))
    return keys.join(t, key)


def _band(length: Column) -> Column:
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / math.log(BAND)).cast("int")


def _theta(left: DataFrame, index: PatternIndex, cond: Column, how: str, threshold: int) -> DataFrame:
    """Question keys against pattern keys under ``cond``, which implies the length and
    bag bounds of ``threshold``.  Blocked, a semi join gives a key once per
    block that holds a match."""
    if index.broadcast:
        return left.join(F.broadcast(index.df), cond, how)
    index = index.sliced()
    return _blocked(left, index.df, index.rarity, cond, how, threshold)


def _blocked(left: DataFrame, patterns: DataFrame, rarity: DataFrame, cond: Column, how: str, threshold: int) -> DataFrame:
    k = _least_share(threshold)
    n = F.col("qlen")
    q = _prefixed(left, "qkey", "qbag", "qlen", rarity, threshold, "_qp").withColumn("_qt", F.explode("_qp"))
    q = q.withColumn("_qb", F.explode(F.sequence(_band(F.floor(n * k) - 1), _band(F.ceil(n / k) + 1))))
    p = _prefixed(patterns, "pkey", "pbag", "plen", rarity, threshold, "_pp").withColumn("_pt", F.explode("_pp"))
    p = p.withColumn("_pb", _band(F.col("plen")))
    first = F.element_at(F.array_intersect("_qp", "_pp"), 1) == F.col("_qt")
    return q.join(p, (F.col("_qt") == F.col("_pt")) & (F.col("_qb") == F.col("_pb")) & first & cond, how)


def _tested(keys: DataFrame, n_keys: int, patterns: DataFrame, threshold: int) -> DataFrame:
    """``qkey, rank``: the first of ``patterns`` that each of ``keys`` passes.  Every chunk of keys meets
    every block of patterns, each such pair in a group of its own."""
    n_chunks = max(1, -(-n_keys // KEY_CHUNK))
    blocks = [r["_b"] for r in patterns.select(F.floor(F.col("rank") / PATTERN_BLOCK).cast("int").alias("_b")).distinct().collect()]
    left = keys.select("qkey", F.pmod(F.xxhash64("qkey"), F.lit(n_chunks)).cast("int").alias("_c"),
                       F.explode(F.array(*[F.lit(b) for b in blocks])).alias("_b")) if blocks else None
    if left is None:
        return keys.select("qkey", F.lit(0).cast("bigint").alias("rank")).limit(0)
    right = patterns.select("pkey", F.col("rank").cast("bigint").alias("rank"), F.floor(F.col("rank") / PATTERN_BLOCK).cast("int").alias("_b"),
                            F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("_c"))

    def test(chunk: pa.Table, block: pa.Table) -> pa.Table:
        block = block.sort_by("rank")
        names, ranks = chunk.column("qkey"), block.column("rank").to_numpy()
        found = S.first_passing(names.to_pylist(), block.column("pkey").to_pylist(), threshold)
        hit = found >= 0
        return pa.table({"qkey": names.filter(pa.array(hit)), "rank": pa.array(ranks[found[hit]], pa.int64())})

    # dealt over a stated number of tasks: their bytes tell nothing of their work
    spark = keys.sparkSession
    n = min(n_chunks * len(blocks), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    left, right = (side.repartition(n, "_c", "_b").groupBy("_c", "_b") for side in (left, right))
    pairs = left.cogroup(right).applyInArrow(test, "qkey string, rank long")
    return pairs.groupBy("qkey").agg(F.min("rank").alias("rank"))


def _in_turn(feats: DataFrame, index: PatternIndex, threshold: int, best: bool) -> DataFrame:
    """``qkey`` and, if ``best``, the first passing pattern as ``m`` (pattern, score), slice by slice."""
    spark, table = feats.sparkSession, index.ranked()
    path = scratch_path(spark, "gate-keys")
    feats.select("qkey").filter(F.col("qkey").isNotNull()).write.parquet(path)
    open_ = spark.read.parquet(path)
    n_open, n_patterns = open_.count(), table.count()
    found, lo = [], 0
    for hi in (*(h for h in SLICES if h < n_patterns), n_patterns):
        part = table.filter((F.col("rank") >= lo) & (F.col("rank") < hi)).select("rank", "pkey")
        path = scratch_path(spark, "gate")
        _tested(open_, n_open, part, threshold).write.parquet(path)
        hits, lo = spark.read.parquet(path), hi
        found.append(hits)
        n_open -= hits.count()
        if not n_open:
            break
        open_ = open_.join(hits, "qkey", "left_anti")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    if not best:
        return out.select("qkey")
    score = S.indel_score("qkey", "qlen", "qchars", "pkey", "plen", "pnw", "pmasks", "pinit")
    out = question_features(out).join(out, "qkey").join(table, "rank")
    return out.select("qkey", F.struct(F.col("first_pattern").alias("pattern"), score.alias("score")).alias("m"))


def passing_keys(qkeys: DataFrame, index: PatternIndex, threshold: int, bounds: bool = True,
                 metric: str = "indel") -> DataFrame:
    """M3 over distinct keys: the question keys for which some pattern passes.

    ``metric="exact"`` is the reference-parity mode: a pair whose native M1
    score reaches the threshold (M1 >= M2, so no true match is lost) must reach it by M2 too."""
    feats = question_features(qkeys.select("qkey").distinct())
    if metric == "exact":
        cond = _pair_cond(threshold, bounds) & (S.exact_score("pkey", "qkey") >= int(threshold))
        out = _theta(feats, index, cond, "left_semi", threshold).select("qkey")
        return out if index.broadcast else out.distinct()
    if not index.broadcast:
        return _in_turn(feats, index, threshold, best=False)
    return _theta(feats, index, _pair_cond(threshold, bounds), "left_semi", threshold).select("qkey")


def fuzzy_gate(questions: DataFrame, index: PatternIndex, threshold: int,
               text_col: str = "text", bounds: bool = True, metric: str = "indel") -> DataFrame:
    """M3: adds ``qkey`` and ``gate_passed`` to every question row."""
    q = questions.withColumn("qkey", token_sort_key(F.lower(F.col(text_col))))
    passed = passing_keys(q, index, threshold, bounds, metric).withColumn("gate_passed", F.lit(True))
    return (q.join(passed, "qkey", "left")
            .withColumn("gate_passed", F.coalesce("gate_passed", F.lit(False))))


def pack_index(index: PatternIndex) -> DataFrame:
    """The pattern keys as one row for ``row_gate``: only where they fit the broadcast budget."""
    if not index.broadcast:
        raise ValueError(f"the pattern index exceeds {BROADCAST_CONF}: it cannot be packed into a row")
    rows = index.df.select(F.sort_array(F.collect_list(F.struct("first_pos", "pkey"))).alias("r"))
    return rows.select(F.transform("r", lambda p: p["pkey"]).alias("_patterns"))


def row_gate(questions: DataFrame, packed: DataFrame, threshold: int, ask: Column, text_col: str = "text") -> DataFrame:
    """M3 row by row, for streams: ``gate_passed`` for the rows where ``ask`` holds, else null.

    No aggregation and no state: every batch of rows meets the broadcast pattern keys, each of
    its distinct keys once, and leaves them at the first pattern that passes, like the reference's loop.
    """
    patterns = questions.sparkSession.sparkContext.broadcast(packed.first()["_patterns"])

    @F.pandas_udf("boolean")
    def passes(keys: pd.Series) -> pd.Series:
        distinct = list(dict.fromkeys(keys))
        hit = dict(zip(distinct, S.first_passing(distinct, patterns.value, threshold) >= 0))
        return pd.Series([hit[k] for k in keys], dtype="bool")

    q = questions.withColumn("qkey", F.when(ask, token_sort_key(F.lower(F.col(text_col)))))
    return q.withColumn("gate_passed", F.when(F.col("qkey").isNotNull(), passes("qkey"))).drop("qkey")


def candidate_pairs(qkeys: DataFrame, index: PatternIndex, threshold: int) -> DataFrame:
    """M4: (qkey, pkey) pairs whose length and bag bounds reach the threshold,
    i.e. the only pairs on which the exact score is ever computed."""
    feats = question_features(qkeys.select("qkey").distinct())
    return _theta(feats, index, _bound_cond(threshold), "inner", threshold).select("qkey", "pkey")


def first_match(questions: DataFrame, index: PatternIndex, threshold: int,
                text_col: str = "text") -> DataFrame:
    """M5: per question, the first pattern (document order) reaching the
    threshold, with its score; questions with no match are absent."""
    q = questions.withColumn("qkey", token_sort_key(F.lower(F.col(text_col))))
    feats = question_features(q.select("qkey").distinct())
    if not index.broadcast:
        best = _in_turn(feats, index, threshold, best=True)
        return q.join(best, "qkey").select(*questions.columns, "m.pattern", "m.score")
    score = S.indel_score("qkey", "qlen", "qchars", "pkey", "plen", "pnw", "pmasks", "pinit")
    cond = (F.col("qkey") == F.col("pkey")) | _bound_cond(threshold)
    # scored once per pair, behind the bounds; the best pair is kept as the pairs
    # come, so none is stored.  A filter on the score would be pushed into the join
    # and computed again.
    pairs = _theta(feats, index, cond, "inner", threshold).select("qkey", "first_pos", "first_pattern", score.alias("score"))
    best = pairs.groupBy("qkey").agg(F.min_by(
        F.struct(F.col("first_pattern").alias("pattern"), "score"),
        F.when(F.col("score") >= int(threshold), F.col("first_pos"))).alias("m"))
    return q.join(best.filter(F.col("m").isNotNull()), "qkey").select(*questions.columns, "m.pattern", "m.score")


def pair_scores(pairs: DataFrame, left_col: str, right_col: str, exact: bool = False) -> DataFrame:
    """M1 / M2 on given (question text, pattern text) pairs; both texts are
    lower-cased first, as the reference does.  Adds ``score``.

    M1: the distinct pattern keys get their bitmasks once and are equi-joined
    back to the pairs (a null text has a null score).  M2: its own fold on the
    prepared keys.
    """
    keyed = (pairs.withColumn("qkey", token_sort_key(F.lower(F.col(left_col))))
             .withColumn("pkey", token_sort_key(F.lower(F.col(right_col)))))
    if exact:
        return keyed.withColumn("score", S.exact_score("pkey", "qkey")).drop("qkey", "pkey")
    feats = key_features(keyed.select("pkey").filter(F.col("pkey").isNotNull()).distinct())
    q = keyed.withColumn("qlen", F.length("qkey")).withColumn("qchars", S.chars_of("qkey"))
    score = S.indel_score("qkey", "qlen", "qchars", "pkey", "plen", "pnw", "pmasks", "pinit")
    scored = F.when(F.col("qkey").isNotNull() & F.col("pkey").isNotNull(), score)
    return q.join(feats, "pkey", "left").withColumn("score", scored).select(*pairs.columns, "score")
