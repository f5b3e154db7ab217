"""Connected components of an edge table, by alternating large and small stars.

Each round is two shuffles by node and one that drops repeats; the table shrinks to stars in a
number of rounds that grows with the logarithm of the longest path.  Every
round is written to the shared folder, so no lineage grows and a lost executor
costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from askbase.llm.common import written

#: Edges that make a task of their own worth while: small tables take few tasks and files a round.
TASK_EDGES = 100_000


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that edges reach, for every node on
    an edge.  Edges from a node to itself name a component of one."""
    own = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    before, rows = None, own.count()
    ordered = own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(ordered.coalesce(rows // TASK_EDGES + 1), "edges")
    while True:
        seen, tasks = Observation(), rows // TASK_EDGES + 1
        stars = _small_star(_large_star(now).coalesce(tasks)).coalesce(tasks).observe(
            seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        now = written(stars, "stars")
        after = seen.get
        if after == before:
            break
        before, rows = after, after["n"]
    hubs = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs).distinct()


def _least() -> Column:
    return F.min("v").over(Window.partitionBy("u"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.withColumn("m", F.least(_least(), "u")).filter("v > u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(edges.filter("u = v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    own = edges.withColumn("m", _least())
    moved = F.when(F.col("v") == F.col("m"), F.array("u")).otherwise(F.array("u", "v"))
    return own.select(F.explode(moved).alias("u"), F.col("m").alias("v")).distinct()
