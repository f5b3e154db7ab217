"""Keyword rules as a table (F1-F3 for rule sets of any size).

Rules: ``profile, priority, route, phrase``; the smallest priority whose phrase a
text contains wins, per profile.  Testing every phrase on every text is
phrases x texts; instead each phrase is looked up under one of its 3-grams, the one
that the fewest texts hold (counted over all texts).  Texts meet the phrases in an
equi-join on those grams, and only those pairs are tested for the phrase itself.

Texts are reduced to distinct ones first, so a text asked a million times is tested
once.  Phrases shorter than a gram are looked up whole.  Rules that share profile and phrase
are reduced to the first of them before they meet the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askbase.operators.routing import PROFILES
from askbase.operators.sizing import sized_broadcast
from askbase.session import scratch_path

GRAM = 3
RULES = "profile string, priority int, route string, phrase string"


def built_in_rules(spark: SparkSession) -> DataFrame:
    """The reference's rules of every profile as a table."""
    rows = [(p.name, i, route, phrase) for p in PROFILES.values() for i, (route, phrases) in enumerate(p.rules) for phrase in phrases]
    return spark.createDataFrame(rows, RULES)


def _grams(text: str, n: int) -> Column:
    """Distinct substrings of ``n`` characters; the empty one of every text for ``n`` = 0."""
    if n == 0:
        return F.array(F.lit(""))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(places, lambda i: F.substring(F.col(text), i, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def match_phrases(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``low, phrase``: the phrases that each distinct ``low`` contains.  Null texts and phrases match nothing."""
    texts = texts.select("low").filter(F.col("low").isNotNull())
    phrases = phrases.select("phrase").filter(F.col("phrase").isNotNull()).distinct()
    sized = phrases.withColumn("n", F.least(F.length("phrase"), F.lit(GRAM)))
    lengths = sorted(r["n"] for r in sized.select("n").distinct().collect())
    if not lengths:
        return texts.limit(0).withColumn("phrase", F.lit(""))
    own = None
    for n in lengths:
        part = sized.filter(F.col("n") == n).select("phrase", F.explode(_grams("phrase", n)).alias("gram"))
        own = part if own is None else own.unionByName(part)
    own = _kept(own, "phrase-grams")
    held = F.array_union(_grams("low", lengths[0]), F.array().cast("array<string>"))
    for n in lengths[1:]:
        held = F.array_union(held, _grams("low", n))
    seen = texts.select("low", F.explode(held).alias("gram"))
    wanted = sized_broadcast(own.select("gram").distinct())
    # how many texts hold each gram of a phrase; a phrase with a gram that none holds is in no text
    counts = seen.select("gram").join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    rarest = own.join(sized_broadcast(_kept(counts, "gram-counts")), "gram", "left").groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("g"))
    anchors = _kept(rarest.filter("g.held > 0").select("phrase", "g.gram"), "anchors")
    pairs = seen.join(sized_broadcast(anchors), "gram")
    return pairs.filter(F.contains("low", F.col("phrase"))).select("low", "phrase")


def route_by_rules(questions: DataFrame, rules: DataFrame, id_col: str = "question_id", text_col: str = "text") -> DataFrame:
    """``id, profile, route, priority, phrase`` for every question and profile.

    The route is null where no rule matches; of one priority the smallest phrase counts.
    A null text matches nothing.
    """
    low = F.lower(F.col(text_col))
    texts = _kept(questions.select(low.alias("low")).filter(F.col("low").isNotNull()).distinct(), "texts")
    rules = rules.select("profile", "priority", "route", "phrase")
    # of the rules of a profile with the same phrase only the first can win: a matched phrase meets one rule a profile
    first = rules.groupBy("profile", "phrase").agg(F.min(F.struct("priority", "route")).alias("f"))
    first = _kept(first.select("profile", "phrase", "f.priority", "f.route"), "first-rules")
    won = match_phrases(texts, rules).join(sized_broadcast(first), "phrase").groupBy("low", "profile").agg(
        F.min(F.struct("priority", "phrase", "route")).alias("r"))
    won = won.groupBy("low").agg(F.map_from_entries(F.collect_list(F.struct("profile", "r"))).alias("by"))
    profiles = [r["profile"] for r in rules.select("profile").distinct().orderBy("profile").collect()]
    out = questions.select(F.col(id_col), low.alias("low")).join(won, "low", "left")
    out = out.select(id_col, "by", F.explode(F.array(*[F.lit(p) for p in profiles])).alias("profile")) if profiles else \
        out.select(id_col, "by").withColumn("profile", F.lit(None).cast("string")).limit(0)
    r = F.try_element_at("by", F.col("profile"))
    return out.select(id_col, "profile", r["route"].alias("route"), r["priority"].alias("priority"), r["phrase"].alias("phrase"))
