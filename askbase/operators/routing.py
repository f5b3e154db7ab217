"""Keyword routing (F1-F3): ordered rules, first match wins.

Rules are data (a profile = ordered (route, phrases) list + threshold), but
they are compiled into one ``CASE WHEN`` so Catalyst folds the literals and
evaluates lazily per row: later rules are skipped once one fires.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from askbase import constants as K
from askbase.functions.text import contains_any


@dataclass(frozen=True)
class Profile:
    name: str
    rules: list = field(default_factory=list)   # [(route, [phrases])] in priority order
    threshold: int | None = None                 # None = no fuzzy gate


def _rules(meal):
    return [(K.ROUTE_MEAL, meal), (K.ROUTE_DATE, K.DATE_PHRASES), (K.ROUTE_TIME, K.TIME_PHRASES),
            (K.ROUTE_WEEKDAY, K.WEEKDAY_PHRASES), (K.ROUTE_TOMORROW, K.TOMORROW_PHRASES)]


WEB = Profile("web", _rules(K.MEAL_PHRASES_WEB), K.THRESHOLD_WEB)
LOCAL = Profile("local", _rules(K.MEAL_PHRASES_LOCAL), K.THRESHOLD_LOCAL)
TRAIN = Profile("train", [], None)
PROFILES = {p.name: p for p in (WEB, LOCAL, TRAIN)}


def keyword_any(text_lower, phrases) -> Column:
    """raw substring test of the lower-cased text against any phrase."""
    return contains_any(text_lower, phrases)


def route_expr(text_lower, profile: Profile = WEB) -> Column:
    """the route of the first rule that fires, else null."""
    out = None
    for route, phrases in profile.rules:
        cond = keyword_any(text_lower, phrases)
        out = F.when(cond, F.lit(route)) if out is None else out.when(cond, F.lit(route))
    return out if out is not None else F.lit(None).cast("string")


def route_intent(questions: DataFrame, profile: Profile = WEB, text_col: str = "text") -> DataFrame:
    """F2 over a table: adds ``route`` (null = not keyword-routed)."""
    return questions.withColumn("route", route_expr(F.lower(F.col(text_col)), profile))


def route_profiles(questions: DataFrame, profiles=(WEB, LOCAL), text_col: str = "text") -> DataFrame:
    """every question under every profile, without a join: the profile list
    is a literal array exploded per row, and the route is a CASE on it."""
    names = F.array(*[F.lit(p.name) for p in profiles])
    q = questions.withColumn("profile", F.explode(names))
    low = F.lower(F.col(text_col))
    expr = None
    for p in profiles:
        cond = F.col("profile") == p.name
        expr = F.when(cond, route_expr(low, p)) if expr is None else expr.when(cond, route_expr(low, p))
    thr = None
    for p in profiles:
        cond = F.col("profile") == p.name
        val = F.lit(p.threshold).cast("int")
        thr = F.when(cond, val) if thr is None else thr.when(cond, val)
    return q.withColumn("route", expr).withColumn("threshold", thr)
