"""Quality classifier (operator 7): weak labels by EM, then a hashed linear scorer.

Two tasks, ``junk`` and ``toxic``, each with overlapping heuristic labellers
that vote bad (1), good (0) or abstain (None).

1. Labellers of junk look at style; labellers of toxic at a word list each: some
   fixed English insults, and words and stems learned from a labelled table, if one
   is given.  Of at most ``labelled_docs`` rows (chosen by the hash of the id) these
   are the stems that almost only toxic documents have, taken greedily while each
   still finds ``MIN_GAIN`` further documents, and dealt to the lists in turn, so
   that every list knows something of every language.
2. One pass over every whole text writes, per row, the votes and the hashed
   features (words, word stems and binned style figures, 30 bits each); everything after
   it reads that table and no text.  The patterns of votes are counted over all rows.
3. Expectation-maximisation over these counts estimates the share of bad
   documents and every labeller's accuracy on bad and on good ones
   (labellers are taken as independent given the class); a pattern's
   posterior follows.
4. The posterior labels train a linear scorer per task.  Features are chosen
   and weights fitted on a sample bounded by ``sample_docs`` documents (chosen by
   the hash of their text); at most ``max_features`` weights are kept, so
   what the executors get has a fixed bound.
5. Every row of the table gets the mean of scorer and posterior
   per task; a document is kept if both means are under the threshold.  (The
   scorer sees what no labeller looks at; the posterior keeps it from rejecting very short
   texts that miss the usual words.)

The labels of the quality column are not used for fitting; tests hold the
result against them.

Edge cases: null or blank text has no words: junk (1.0); repeated rows
and null ids are scored row by row; extra columns are ignored; an empty table
gives an empty result.  If the sample shows one class only, the scorer falls
back to rejecting nothing.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from itertools import chain, zip_longest
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from askbase.llm.common import hash_sample, sized, text_key, written

SAMPLE_DOCS, LABELLED_DOCS, MAX_FEATURES, MIN_SUPPORT = 12_000, 20_000, 512, 8
MIN_GAIN, MIN_PRECISION, STEM = 4, 0.98, 4
KNOWN_TOKENS, TRUST = 60_000, {"junk": 0.0, "toxic": 20.0}
#: Rows looked at together, and the seed of the sample.
SLICE, SEED = 512, 7
_SYMBOLS = b"#*$%&|<>^~{}\\"
_CAPS, _SMALL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_LETTER = re.compile(r"[^\W\d_]")
_TOKEN = re.compile(r"[^\W\d_]+")

#: Abusive words by strength of the insult to a person, to their worth, and of disgust.
INSULTS = ["idiot", "moron", "stupid", "clown"]
BELITTLING = ["loser", "pathetic", "worthless", "trash"]
DISGUST = ["scum", "disgusting", "filth", "vermin"]


def style(text: str, words: list[str]) -> dict[str, float]:
    """Figures of a text that do not depend on its language."""
    n = max(len(words), 1)
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    caps, small = size - len(raw.translate(None, _CAPS)), size - len(raw.translate(None, _SMALL))
    grams = max(len(words) - 2, 0)
    count = Counter(words)
    return {
        "n": len(words),
        "symbols": (size - len(raw.translate(None, _SYMBOLS))) / n,
        "caps": caps / max(caps + small, 1),
        "bangs": text.count("!") / n,
        "runs": sum(map(eq, words, words[1:])) / n,
        "repeats": 1 - len(set(zip(words, words[1:], words[2:]))) / grams if grams else 0.0,
        "variety": len(count) / n,
        "letterless": sum(k for w, k in count.items() if not _LETTER.search(w)) / n,
        "short": sum(k for w, k in count.items() if len(w) <= 3) / n,
    }


def _vote(value: float, good: float, bad: float) -> int | None:
    return 1 if value >= bad else 0 if value <= good else None


def junk_votes(s: dict[str, float]) -> tuple:
    """Votes of the labellers of junk; short texts make the rate labellers abstain."""
    n = s["n"]
    return (
        _vote(s["symbols"], 0.05, 0.3),
        _vote(s["caps"], 0.3, 0.6) if n >= 3 else None,
        _vote(s["bangs"], 0.1, 0.5),
        _vote(s["runs"], 0.05, 0.3) if n >= 10 else None,
        _vote(s["repeats"], 0.3, 0.6) if n >= 20 else None,
        _vote(s["letterless"], 0.2, 0.42),
        _vote(1 - s["variety"], 0.6, 0.85) if n >= 20 else None,
        _vote(0.25 - s["short"], 0.1, 0.2) if n >= 20 else None,
    )


def hash30(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) >> 34


def token_features(token: str) -> tuple[int, ...]:
    """Hashes of a word and of its stem."""
    return (hash30(token), hash30("^" + token[:STEM])) if len(token) > STEM else (hash30(token),)


def style_features(s: dict[str, float]) -> list[int]:
    return [hash30(f"\x00{k}={min(int(v * 10), 40) if k != 'n' else int(math.log2(v + 1))}") for k, v in s.items()]


class Reader:
    """Votes and features of texts, with a bounded table of tokens."""

    def __init__(self, stems: list[list[int]]):
        fixed = [{hash30(w) for w in group} for group in (INSULTS, BELITTLING, DISGUST)]
        self.groups = [a | set(b) for a, b in zip_longest(fixed, stems, fillvalue=())]
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[int, str, str, set[int]]:
        """(words, votes on junk, votes on toxic, features)."""
        text = text or ""
        words = text.split()
        s = style(text, words)
        known, on = self.known, set()
        if len(known) >= KNOWN_TOKENS:
            known.clear()
        for t in set(_TOKEN.findall(text.lower())):
            hit = known.get(t)
            if hit is None:
                known[t] = hit = token_features(t)
            on.update(hit)
        junk = code(junk_votes(s)) if words else "1" * len(junk_votes(s))
        toxic = code(tuple(int(not on.isdisjoint(g)) for g in self.groups))
        on.update(style_features(s))
        return s["n"], junk, toxic, on


def code(votes: tuple) -> str:
    return "".join("-" if v is None else str(v) for v in votes)


def learn_stems(docs: DataFrame, labels: DataFrame, labelled_docs: int = LABELLED_DOCS, groups: int = 3) -> list[list[int]]:
    """Hashes of words and stems that tell toxic documents, dealt to labellers."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(
        "doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = hash_sample(known, "doc_id", labelled_docs, known.count(), seed=13)
    rows = docs.select("doc_id", "text").join(sized(known, 64), "doc_id").select("text", "toxic").distinct()

    def read(batches):
        for b in batches:
            on = [sorted({f for t in set(_TOKEN.findall((text or "").lower())) for f in token_features(t)})
                  for text in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(on, pa.list_(pa.int32())), b.column(1).cast(pa.int32())],
                                             names=["f", "toxic"])

    seen = written(rows.mapInArrow(read, "f array<int>, toxic int").withColumn("row", F.monotonically_increasing_id()),
                   "labelled")
    each = seen.select("row", "toxic", F.explode("f").alias("f"))
    good = each.groupBy("f").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).filter(
        (F.col("bad") >= MIN_GAIN) & (F.col("bad") >= MIN_PRECISION * F.col("n")))
    pairs = each.filter("toxic = 1").join(good.select("f"), "f").select("f", "row")
    found: dict[int, set[int]] = {}
    for r in pairs.collect():          # toxic rows of the bounded sample only
        found.setdefault(r["f"], set()).add(r["row"])
    chosen: list[int] = []
    while found:
        best = max(sorted(found), key=lambda f: len(found[f]))
        gained = found.pop(best)
        if len(gained) < MIN_GAIN:
            break
        chosen.append(best)
        found = {f: left for f, r in found.items() if len(left := r - gained) >= MIN_GAIN}
    return [chosen[k::groups] for k in range(groups)]


def fit_labellers(patterns: dict[str, int], rounds: int = 200, prior: float = 0.15,
                  trust: float = 0.0) -> dict[str, float]:
    """Posterior of bad for each pattern of votes, by EM over pattern counts.

    ``trust`` is the weight, in corpora of this size, of a prior belief that a
    labeller does not vote bad on good documents.  Word lists get it: their
    precision is known beforehand, and each language meets only few of them, which
    would otherwise look like chance votes.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    bad = np.array([[c == "1" for c in k] for k in keys], float)
    good = np.array([[c == "0" for c in k] for k in keys], float)
    # a start that says which class is bad: any vote for it weighs more than votes against it
    post = np.where(bad.any(1), 0.9, 0.02)
    for _ in range(rounds):
        w1, w0 = n * post, n * (1 - post)
        prior = min(max((w1.sum() + 1) / (n.sum() + 2), 1e-6), 1 - 1e-6)
        hit = ((w1 @ bad) + 0.5) / ((w1 @ (bad + good)) + 1)      # votes bad, given bad
        false = ((w0 @ bad) + 0.05) / ((w0 @ (bad + good)) + 1 + trust * n.sum())   # votes bad, given good
        hit, false = np.clip(hit, 1e-4, 1 - 1e-4), np.clip(false, 1e-6, 1 - 1e-4)
        log = (math.log(prior / (1 - prior)) + bad @ np.log(hit / false) + good @ np.log((1 - hit) / (1 - false)))
        new = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(keys, post.tolist()))


def fit_linear(rows: list[tuple[list[int], float]], dims: int, rounds: int = 300, l2: float = 1e-3):
    """Logistic regression on soft labels: (bias, weights), by accelerated gradient descent."""
    x = np.zeros((len(rows), dims), np.float32)
    y = np.array([p for _, p in rows], np.float32)
    for i, (on, _) in enumerate(rows):
        x[i, on] = 1
    w, b = np.zeros(dims, np.float32), 0.0
    v, u, step = w.copy(), b, 4.0 / max(float((x * x).sum(1).max(initial=1)) + 1, 1)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v + u, -30, 30)))
        d = (p - y) / max(len(rows), 1)
        w2, b2 = v - step * (x.T @ d + l2 * v / 10), u - step * float(d.sum())
        m = k / (k + 3)
        v, u = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return float(b), w


def read(docs: DataFrame, stems: list[list[int]], carry: list[str]) -> DataFrame:
    """One reading of every text: ``c0, c1, ...`` (the columns of ``carry``), ``h`` (hash of the
    text), ``n`` (words), ``junk`` and ``toxic`` (votes) and ``f`` (features, ascending)."""
    at = carry.index("text") if "text" in carry else len(carry)
    src = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)],
                      *([] if "text" in carry else [F.col("text").alias(f"c{at}")]), F.xxhash64(F.lit(SEED), "text").alias("h"))
    keep = [f"c{i}" for i in range(len(carry))] + ["h"]
    schema = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in keep)

    def run(batches):
        reader = Reader(stems)
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                part = b.slice(k, SLICE)
                got = [reader(t) for t in part.column(at).to_pylist()]
                on = [sorted(g[3]) for g in got]
                offsets = np.cumsum([0, *map(len, on)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(on), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(n)) for n in keep), pa.array([g[0] for g in got], pa.int32()),
                     pa.array([g[1] for g in got]), pa.array([g[2] for g in got]),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*keep, "n", "junk", "toxic", "f"])

    return src.mapInArrow(run, f"{schema}, n int, junk string, toxic string, f array<int>")


def fit(docs: DataFrame, labels: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS,
        max_features: int = MAX_FEATURES) -> dict:
    """The model: stems, and per task the vote posteriors and the linear scorer.
    ``labels`` (doc_id, toxic) may cover any part of ``docs``."""
    stems = learn_stems(docs, labels) if labels is not None else []
    return fit_table(written(read(docs, stems, []), "votes"), stems, sample_docs, max_features)


def fit_table(rows: DataFrame, stems: list[list[int]], sample_docs: int = SAMPLE_DOCS, max_features: int = MAX_FEATURES) -> dict:
    """``fit`` over what ``read`` has written."""
    counts = rows.groupBy("junk", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    model: dict = {"stems": stems, "total": sum(r["n"] for r in counts)}
    for task in ("junk", "toxic"):
        patterns: Counter = Counter()
        for r in counts:
            patterns[r[task]] += r["n"]
        model[task] = {"posterior": fit_labellers(patterns, trust=TRUST[task])}
    sample = hash_sample(rows, "h", sample_docs, model["total"], seed=SEED).dropDuplicates(["h"])
    sample = written(sample.select("junk", "toxic", "f"), "sample")
    for task in ("junk", "toxic"):
        model[task].update(_fit_scorer(sample, task, model[task]["posterior"], max_features))
    return model


def _fit_scorer(sample: DataFrame, task: str, posterior: dict[str, float], max_features: int) -> dict:
    table = F.from_json(F.lit(json.dumps(posterior)), "map<string,double>")
    rows = sample.select(F.coalesce(F.try_element_at(table, F.col(task)), F.lit(0.0)).alias("p"), "f")
    size, bad_total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("p"), F.lit(0.0))).first()
    share = bad_total / size if size else 0.0
    if not 1 <= bad_total <= size - 1:
        return {"bias": -30.0, "weights": {}}
    found = rows.select("p", F.explode("f").alias("f")).groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("bad")).filter(F.col("n") >= MIN_SUPPORT)
    # how far the feature's share of bad documents is from the sample's, in standard errors
    z = F.abs(F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    top = sorted(r["f"] for r in found.withColumn("z", F.round(z, 6)).filter("z > 6").orderBy(F.desc("z"), "f").limit(
        max_features).select("f").collect())
    if not top:
        return {"bias": -30.0, "weights": {}}
    on = F.array_sort(F.array_intersect("f", F.from_json(F.lit(json.dumps(top)), "array<int>")))
    at = {f: i for i, f in enumerate(top)}
    data = sorted(([at[f] for f in r["x"]], r["p"]) for r in rows.select(on.alias("x"), "p").collect())
    bias, w = fit_linear(data, len(top))
    return {"bias": bias, "weights": {f: float(w[i]) for f, i in at.items() if w[i]}}


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_junk, p_toxic, kept) per row, in the order of the input's partitions."""
    return _named(_scored(read(docs, model["stems"], ["doc_id"]), model, threshold), ["doc_id"])


def keep_good(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    rows = _scored(read(docs, model["stems"], docs.columns), model, threshold).filter("kept")
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def fit_and_score(docs: DataFrame, labels: DataFrame | None, threshold: float = 0.5) -> DataFrame:
    """``score`` by the model of ``docs`` themselves, their texts read once."""
    stems = learn_stems(docs, labels) if labels is not None else []
    rows = written(read(docs, stems, ["doc_id"]), "votes")
    return _named(_scored(rows, fit_table(rows, stems), threshold), ["doc_id"])


def fit_and_keep(docs: DataFrame, labels: DataFrame | None, threshold: float = 0.5) -> DataFrame:
    """``keep_good`` by the model of ``docs`` themselves, their texts read once; rejected rows are
    told by id and text hash, so no text is written."""
    stems = learn_stems(docs, labels) if labels is not None else []
    rows = written(read(docs.select("doc_id", "text", text_key().alias("tk")), stems, ["doc_id", "tk"]), "votes")
    gone = _scored(rows, fit_table(rows.drop("c0", "c1"), stems), threshold).filter(~F.col("kept"))
    gone = written(gone.select(F.col("c0").alias("_gone_id"), F.col("c1").alias("_gone_key")).distinct(), "rejected")
    keyed = docs.withColumn("_own_key", text_key())
    return keyed.join(sized(gone, 48), keyed["doc_id"].eqNullSafe(gone["_gone_id"]) & (
        keyed["_own_key"] == gone["_gone_key"]), "left_anti").select(*docs.columns)


def _named(rows: DataFrame, carry: list[str]) -> DataFrame:
    out = rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "p_junk", "p_toxic", "kept")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _scored(rows: DataFrame, model: dict, threshold: float) -> DataFrame:
    """Rows of ``read`` with ``p_junk, p_toxic, kept`` in place of votes and features.
    Only those go to Python, slice by slice; carried columns stay where they are."""
    tasks = []
    for t in ("junk", "toxic"):
        top = np.array(sorted(model[t]["weights"]), np.int32)
        tasks.append((model[t]["bias"], top, np.array([model[t]["weights"][int(f)] for f in top]), model[t]["posterior"]))

    def some(n: pa.Array, votes: list[pa.Array], lists: pa.Array) -> pa.Array:
        f = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n), dtype=np.int32), lists.value_lengths().to_numpy())
        p = []
        for (bias, top, weight, posterior), vote in zip(tasks, votes):
            x = np.full(len(n), bias)
            if len(top):
                at = np.minimum(np.searchsorted(top, f), len(top) - 1)
                hit = top[at] == f
                x += np.bincount(row[hit], weights=weight[at[hit]], minlength=len(n))
            prior = np.array([posterior.get(v, 0.0) for v in vote.to_pylist()])
            p.append((1 / (1 + np.exp(-np.clip(x, -30, 30))) + prior) / 2)
        words = n.to_numpy() > 0
        return pa.StructArray.from_arrays([pa.array(np.where(words, p[0], 1.0)), pa.array(np.where(words, p[1], 0.0))],
                                          names=["p_junk", "p_toxic"])

    def score_rows(n: pa.Array, junk: pa.Array, toxic: pa.Array, f: pa.Array) -> pa.Array:
        parts = [some(n.slice(k, SLICE), [junk.slice(k, SLICE), toxic.slice(k, SLICE)], f.slice(k, SLICE))
                 for k in range(0, len(n), SLICE)]
        return pa.concat_arrays(parts) if parts else some(n, [junk, toxic], f)

    scores = F.arrow_udf(score_rows, "p_junk double, p_toxic double")(F.col("n"), F.col("junk"), F.col("toxic"), F.col("f"))
    keep = [c for c in rows.columns if c[0] == "c" and c[1:].isdigit()]
    out = rows.select(*keep, scores.alias("_p")).select(*keep, "_p.p_junk", "_p.p_toxic")
    return out.withColumn("kept", F.greatest("p_junk", "p_toxic") < threshold)
