"""S1 for one huge intents document: read by lines, by many tasks.

A JSON document as a whole is one value for one task.  Here it is read as text,
which Spark splits anywhere; a line never begins inside a string, so how deep it
lies in brackets is the sum of the brackets before it:

1. per line, brackets outside strings are counted; sums run within a split, and
   each split starts from the total of the splits before it (one row per split);
2. lines that reach up to the array of intents are cut into tokens, all others are inside one
   intent and stay whole;
3. intents are numbered by counting their opening brackets the same way, and the pieces
   of one number are put together and parsed on their own.

A task holds a split, and then some intents; an intent may lie across splits.  The
result is that of ``read_intents(layout="document")``; elements of the array that are no
objects are not intents and have no place in the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from askbase import schemas
from askbase.session import scratch_path
from askbase.sources.intents import INTENT_FIELDS

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = _STRING + r"|[{}\[\]]|[^\"{}\[\]]++"
_PLACE = ["_file", "_block", "_line"]


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _running(df: DataFrame, counts: dict[str, str], order: list[str]) -> DataFrame:
    """``out`` = sum of ``col`` over all earlier rows of the file, for each ``col: out``: sums within a
    split plus the total of the splits before it."""
    here = Window.partitionBy("_file", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_file", "_block").agg(*[F.sum(c).alias(c) for c in counts])     # a row per split
    totals = totals.select("_file", "_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{o}") for c, o in counts.items()])
    local = df.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(o) for c, o in counts.items()])
    out = local.join(totals, ["_file", "_block"])
    for o in counts.values():
        out = out.withColumn(o, F.col(o) + F.col(f"_{o}")).drop(f"_{o}")
    return out


def _count(col: str, chars: str):
    return F.length(F.translate(col, "".join(c for c in "{}[]" if c not in chars), ""))


def _depth_change(token: str):
    opens, closes = F.col(token).isin("{", "["), F.col(token).isin("}", "]")
    return F.when(opens, 1).when(closes, -1).otherwise(0)


def read_intents_document(spark: SparkSession, path: str) -> DataFrame:
    """``intent_pos, tag, patterns, responses, context_set`` of the ``{"intents": [...]}`` documents under
    ``path``; positions go on across files in file-name order.  A file that holds no such document fails."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), "value")
    # only brackets are left of a line; the numbers of lines are kept by writing them
    bare = F.regexp_replace(F.regexp_replace("value", _STRING, ""), r"[^{}\[\]]++", "")
    lines = lines.withColumn("_bare", bare).withColumn("_up", _count("_bare", "{[")).withColumn("_down", _count("_bare", "}]"))
    lines = _kept(lines.withColumn("_d", (F.col("_up") - F.col("_down")).cast("bigint")).drop("_bare"), "document-lines")
    lines = _running(lines, {"_d": "_depth"}, ["_line"])
    closed = lines.groupBy("_file").agg(F.sum("_d").alias("_open"), F.min("_depth").alias("_least"))
    whole = F.col("_depth") - F.col("_down") > 2            # never leaves its intent
    tokens = F.when(whole, F.array("value")).otherwise(F.regexp_extract_all("value", F.lit(_TOKEN), F.lit(0)))
    t = lines.select(*_PLACE, "_depth", whole.alias("_whole"), F.posexplode(tokens).alias("_t", "token"))
    in_line = Window.partitionBy(*_PLACE).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("_whole"), 0).otherwise(_depth_change("token"))
    t = t.withColumn("_c", change).withColumn("_at", F.col("_depth") + F.coalesce(F.sum("_c").over(in_line), F.lit(0)))
    t = t.withColumn("_array", ((F.col("token") == "[") & (F.col("_at") == 1) & ~F.col("_whole")).cast("bigint"))
    t = t.withColumn("_object", ((F.col("token") == "{") & (F.col("_at") == 2) & ~F.col("_whole")).cast("bigint"))
    t = _kept(t.filter((F.col("_at") > 2) | (F.col("_object") == 1) | (F.col("_at") == 1)).select(
        *_PLACE, "_t", "token", "_at", "_array", "_object"), "document-tokens")
    t = _running(t, {"_array": "_arrays", "_object": "_objects"}, ["_line", "_t"])
    # the key of an array is the last string before it at the top level, of which there are few
    top = Window.partitionBy("_file").orderBy("_block", "_line", "_t").rowsBetween(Window.unboundedPreceding, -1)
    named = t.filter((F.col("_at") == 1) & (F.col("token").startswith('"') | (F.col("_array") == 1)))
    named = named.withColumn("_key", F.last(F.when(F.col("token").startswith('"'), F.col("token")), True).over(top))
    named = named.filter("_array = 1 and _key = '\"intents\"'").select("_file", (F.col("_arrays") + 1).alias("_section"))
    inside = t.filter("_at > 2 or _object = 1").select(
        "_file", F.col("_arrays").alias("_section"), (F.col("_objects") + F.col("_object")).alias("_number"),
        F.struct("_block", "_line", "_t", "token").alias("_p"))
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list("_p")), lambda p: p["token"]), "")
    found = inside.join(F.broadcast(named), ["_file", "_section"]).groupBy("_file", "_section", "_number").agg(pieces.alias("_json"))
    found = _kept(found.withColumn("i", F.from_json("_json", schemas.INTENT, {"mode": "FAILFAST"})).drop("_json"), "document-intents")
    # one row per file: is it a document, how many intents do the files before it have
    sizes = closed.join(named.groupBy("_file").agg(F.count(F.lit(1)).alias("_sections")), "_file", "left").join(
        found.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.min("_number").alias("_first")), "_file", "left")
    good = (F.col("_open") == 0) & (F.col("_least") >= 0) & (F.coalesce("_sections", F.lit(0)) == 1)
    sizes = sizes.withColumn("_n", F.when(good, F.coalesce("_n", F.lit(0))).otherwise(
        F.raise_error(F.lit("a file holds no intents document"))))
    sizes = _kept(sizes.select("_file", "_n", "_first"), "document-files")
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_off", offset)
    return found.join(sizes, "_file").select((F.col("_off") + F.col("_number") - F.col("_first")).cast("int").alias("intent_pos"),
                                             *[F.col("i")[f].alias(f) for f in INTENT_FIELDS])
