"""Mixing sources to target weights (operator 6): soft membership, DataFrame functions only.

1. ``fit_domains``: multinomial naive Bayes over words hashed to ``dims``
   buckets, counted on labelled rows (a sample bounded by ``sample_docs``,
   chosen by the hash of the id).  Domains x dims counts reach the driver.
2. ``domain_posteriors``: every whole text is scored with the weights, which
   are literals of the plan; a document's words meet in the map-side sum, so
   one row per document is shuffled.  Evidence is scaled to at most
   ``evidence_words`` words, or long texts would always be certain.
3. ``fit_rates``: minimise sum_k (S_k - t_k)^2 / c_k over rates r >= 0, where
   S_k = sum_i tokens_i p_ik r_i, t_k the target and c_k = S_k at r = 1.
   Projected gradient from r = 1 in the metric of tokens: the step
   r_i <- max(0, r_i - sum_k p_ik (S_k - t_k) / c_k) is safe with length 1,
   as the largest eigenvalue of the scaled Hessian is 1.  Each round is one
   aggregate of a few numbers; the rates themselves are never collected: the
   gradients so far define them.

Edge cases: null or blank text has 0 tokens, the prior as posterior and rate
as that gives; rows labelled with a null id or domain are ignored; a domain
without target is driven to 0; a target without labelled rows cannot be met and is left
out of the fit; repeated rows give a row each; without any labelled row or
any document the result is empty of domains: posterior [], domain null, rate 1.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from askbase.llm.common import hash_sample, sized, text_key, written

DIMS, SAMPLE_DOCS, EVIDENCE_WORDS, SMOOTHING = 4096, 20_000, 40, 0.5
ROUNDS, TOLERANCE = 60, 1e-6


def _words(col: str = "text") -> Column:
    """Lower-cased words between white space."""
    flat = F.translate(F.lower(F.coalesce(F.col(col), F.lit(""))), "\t\n\x0b\f\r", "     ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def _bucket(word: Column, dims: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(dims)).cast("int")


def fit_domains(docs: DataFrame, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dims: int = DIMS) -> dict:
    """``labelled`` has (doc_id, domain).  Returns domains, log priors and weights."""
    known = labelled.select("doc_id", "domain").filter("doc_id is not null and domain is not null").distinct()
    known = hash_sample(known, "doc_id", sample_docs, known.count(), seed=3)
    rows = docs.select("doc_id", "text").join(sized(known, 64), "doc_id")
    per_domain = rows.select("domain", F.explode(F.expr("array(-1)")).alias("bucket"))
    words = rows.select("domain", F.explode(_words()).alias("w")).select("domain", _bucket(F.col("w"), dims).alias("bucket"))
    counts = per_domain.unionByName(words).groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    domains = sorted({r["domain"] for r in counts})
    seen = {k: [0] * dims for k in domains}
    size = dict.fromkeys(domains, 0)
    for r in counts:
        if r["bucket"] < 0:
            size[r["domain"]] = r["n"]
        else:
            seen[r["domain"]][r["bucket"]] = r["n"]
    total = sum(size.values())
    weights = []
    for k in domains:
        mass = math.log(sum(seen[k]) + SMOOTHING * dims)
        weights.append([math.log(c + SMOOTHING) - mass for c in seen[k]])
    return {"domains": domains, "prior": [math.log(size[k] / total) for k in domains], "weights": weights, "dims": dims}


def domain_posteriors(docs: DataFrame, model: dict, evidence_words: int = EVIDENCE_WORDS) -> DataFrame:
    """(doc_id, tk, n_tokens, posterior) per row; posterior follows model['domains']."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", text_key())
    each = rows.select("doc_id", "tk", F.posexplode_outer(_words()).alias("pos", "w"))
    at = _bucket(F.col("w"), model["dims"]) + 1
    # a folded literal each: dims doubles
    tables = [F.from_json(F.lit(json.dumps([round(x, 6) for x in w])), "array<double>") for w in model["weights"]]
    sums = [F.coalesce(F.sum(F.element_at(t, at)), F.lit(0.0)).alias(f"s{k}") for k, t in enumerate(tables)]
    got = each.groupBy("doc_id", "tk").agg(
        F.count("w").alias("n"), F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("copies"), *sums)
    # identical rows are summed together: one row each again
    got = got.withColumn("copies", F.greatest("copies", F.lit(1)))
    scale = F.least(F.lit(1.0) / F.col("copies"), F.lit(float(evidence_words)) / F.greatest("n", F.lit(1)))
    logs = [F.lit(p) + F.col(f"s{k}") * scale for k, p in enumerate(model["prior"])]
    got = got.select("doc_id", "tk", (F.col("n") / F.col("copies")).cast("long").alias("n_tokens"), "copies",
                     F.array(*logs).cast("array<double>").alias("l"))
    got = got.withColumn("l", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    got = got.withColumn("z", F.aggregate("l", F.lit(0.0), lambda a, x: a + x))
    got = got.withColumn("posterior", F.transform("l", lambda x: x / F.col("z")))
    return got.select("doc_id", "tk", "n_tokens", "posterior", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def _rate(gradients: list[list[float]], p: str = "posterior") -> Column:
    """The rate after these steps, as one nested expression."""
    def step(r: Column, g: list[float]) -> Column:
        move = reduce(lambda a, b: a + b, (F.element_at(p, k + 1) * F.lit(x) for k, x in enumerate(g)), F.lit(0.0))
        return F.greatest(F.lit(0.0), r - move)

    return reduce(step, gradients, F.lit(1.0))


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float], rounds: int = ROUNDS,
              tolerance: float = TOLERANCE) -> tuple[Column, dict]:
    """``members`` has (n_tokens, posterior), and should be a written table: it is
    read once a round.  Returns the rate column and a report."""
    def totals(rate: Column) -> list[float]:
        row = members.agg(*[F.sum(F.col("n_tokens") * F.element_at("posterior", k + 1) * rate)
                            for k in range(len(domains))]).first()
        return [x or 0.0 for x in row]

    if not domains:
        return F.lit(1.0), {"targets": {}, "totals": {}, "rounds": 0}
    natural = totals(F.lit(1.0))
    asked = {k: float(w) for k, w in weights.items() if w > 0 and k in domains and natural[domains.index(k)] > 0}
    whole = sum(natural)
    targets = [whole * asked.get(k, 0.0) / sum(asked.values()) if asked else natural[i] for i, k in enumerate(domains)]
    steps: list[list[float]] = []
    now = natural
    while len(steps) < rounds:
        g = [(s - t) / c if c > 0 else 0.0 for s, t, c in zip(now, targets, natural)]
        if max(map(abs, g), default=0.0) <= tolerance:
            break
        steps.append([float(f"{x:.12g}") for x in g])
        now = totals(_rate(steps))
    report = {"targets": dict(zip(domains, targets)), "totals": dict(zip(domains, now)),
              "natural": dict(zip(domains, natural)), "rounds": len(steps)}
    return _rate(steps), report


def mixing_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> tuple[DataFrame, dict]:
    """(doc_id, tk, n_tokens, domain, posterior, rate) per row, and the report of the fit."""
    model = fit_domains(docs, labelled)
    members = written(domain_posteriors(docs, model), "members")
    rate, report = fit_rates(members, model["domains"], weights)
    names = F.array(*[F.lit(k) for k in model["domains"]]).cast("array<string>")
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    domain = F.when(F.size("posterior") > 0, F.try_element_at(names, F.greatest(best, F.lit(1))))
    out = members.select("doc_id", "tk", "n_tokens", domain.alias("domain"), "posterior", rate.alias("rate"))
    return out, report


def repeat_to_rates(docs: DataFrame, rates: DataFrame, report: dict) -> DataFrame:
    """``docs`` with every row as often as its rate says, and at least once.

    Rates are taken in units of the smallest factor that a domain needs, so mixing
    repeats what is short and loses nothing.  The part after the point becomes
    one more copy for as many rows, by a hash of the row: a retry decides alike.
    """
    factors = [report["targets"][k] / c for k, c in report.get("natural", {}).items() if c > 0 and report["targets"][k] > 0]
    unit = min(factors, default=1.0)
    one = rates.groupBy("doc_id", "tk").agg(F.max("rate").alias("rate"))
    rows = docs.withColumn("_mix_tk", F.struct(F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("a"),
                                               F.xxhash64(F.lit(2), F.coalesce("text", F.lit(""))).alias("b")))
    one = one.select(F.col("doc_id").alias("_mix_id"), F.col("tk").alias("_mix_key"), F.col("rate").alias("_mix_rate"))
    joined = rows.join(one, rows["doc_id"].eqNullSafe(one["_mix_id"]) & (rows["_mix_tk"] == one["_mix_key"]), "left")
    chance = F.pmod(F.xxhash64(F.lit(11), "doc_id", "_mix_tk"), F.lit(1 << 20)) / float(1 << 20)
    copies = F.greatest(F.lit(1), F.floor(F.coalesce("_mix_rate", F.lit(1.0)) / unit + chance)).cast("int")
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
