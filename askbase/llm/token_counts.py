"""Token counts (operator 5): overlap resynchronisation for huge documents.

A document of up to ``huge_chars`` code points is counted by its words: a text may
be cut before any single blank, and around any single line feed, that has no other
white space beside it, because a match of the pre-tokenizer that begins at a visible
character ends before white space, and none depends on what is before it.  Every task looks up
words that it has met before (at most ``KNOWN_WORDS`` of them), and encodes the other words of
a text as one piece; texts with any other white space, or with a special string, are encoded whole.  A
longer document is cut into chunks that overlap; the chunks are dealt over the
cluster and encoded with offsets.  Two neighbours are spliced at the first
word boundary that both encodings have inside their overlap.

Why such a boundary is safe: the pre-tokenizer matches from left to right, a
match depends only on the text from its start on, and merges never cross a
match.  Once both scans start a word at the same place they go on alike.
Only the last few characters before a chunk's cut may be read differently
(a contraction or a special string may be cut off), so boundaries
within ``EDGE`` characters of the cut do not count.

If an overlap has no common boundary (a run of letters longer than the
overlap), the document is done again with overlaps ``WIDEN`` times as wide,
and at last as one chunk.  Every document gets the library's exact count.

Edge cases: null text has 0 bytes and 0 tokens; identical rows are counted
once and given back once each; null ids and extra columns do no harm.
"""

from __future__ import annotations

import os
import re
from itertools import filterfalse, repeat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from askbase.llm.common import sized, text_key, written

HUGE_CHARS, CHUNK_CHARS, OVERLAP_CHARS, WIDEN, EDGE = 65_536, 16_384, 256, 16, 32
KNOWN_WORDS, KNOWN_CHARS = 200_000, 64
#: White space that words are not cut at, and the start of what may be a special string.
_ODD = re.compile(r"[^\S \n]|[ \n][ \n]|\A\s|\s\Z|<\|")
COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long"
_LOADED: dict = {}


def load(path: str, offsets_untrimmed: bool = False):
    """The tokenizer of a ``.json`` file, once per Python worker."""
    key = (path, offsets_untrimmed)
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer, processors

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        if offsets_untrimmed:
            t.post_processor = processors.ByteLevel(trim_offsets=False)
        _LOADED[key] = t
    return _LOADED[key]


def cut(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of chunks over ``n`` characters, each starting ``overlap``
    before the end of the one before."""
    if n <= chunk + overlap:
        return [(0, n)]
    out, start = [], 0
    while True:
        end = min(n, start + chunk + overlap)
        out.append((start, end))
        if end == n:
            return out
        start = end - overlap


def word_bounds(encoding) -> list[tuple[int, int]]:
    """(character where a word starts, tokens before it) for every word."""
    out, last = [], object()
    for i, (w, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if w is None or w != last:
            out.append((start, i))
        last = w
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, huge_chars: int = HUGE_CHARS, chunk_chars: int = CHUNK_CHARS,
                 overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = rows.filter(F.length("text") <= huge_chars).mapInArrow(_count_whole(tokenizer_path), COUNT_SCHEMA)
    huge = rows.filter(F.length("text") > huge_chars).withColumn("tk", text_key())
    return short.unionByName(_count_huge(huge, tokenizer_path, chunk_chars, overlap_chars))


def _plain(text: str) -> bool:
    """Whether a text may be cut at its blanks and line feeds; not so for an empty one."""
    flat = text.replace("\n", " ")
    if flat.isprintable():       # no white space but the blank, so a few searches tell
        return not (not flat or "  " in flat or flat[0] == " " or flat[-1] == " " or "<|" in flat)
    return not ("\x00" in text or _ODD.search(text))


class WordCounter:
    """Tokens of whole texts, by a bounded table of their words."""

    def __init__(self, path: str):
        self.t, self.known, self.met = load(path), {}, set()
        self.feed = self._library("\n")

    def _library(self, text: str) -> int:
        return len(self.t.encode(text, add_special_tokens=False))

    def _learn(self, words: list[str]) -> dict[str, int]:
        """Tokens of words as ``_words`` gives them."""
        texts = [w[1:] if w[0] == "\n" else w for w in words]
        counts = [len(e) for k in range(0, len(texts), 1000)
                  for e in self.t.encode_batch_fast(texts[k:k + 1000], add_special_tokens=False)]
        return {w: n + (self.feed if w[0] == "\n" else 0) for w, n in zip(words, counts)}

    @staticmethod
    def _words(text: str) -> list[str]:
        """" word" behind a blank, "\\nword" behind a line feed; the first as behind a line feed."""
        return ("\n" + text).replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")[1:]

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        if len(self.met) > KNOWN_WORDS:
            self.met = set()
        known, met = self.known, self.met
        split = [self._words(x) if _plain(x) else None for x in texts]
        again = set()
        for w in split:
            if w:
                new = set(w).difference(known)
                again |= new & met
                met |= new
        # words met a second time are worth a place in the table; most others never come again
        learnt = [w for w in again if len(w) <= KNOWN_CHARS]
        known.update(self._learn(learnt) if learnt else {})
        met -= again
        rest = [x if w is None else "".join(filterfalse(known.__contains__, w)) for x, w in zip(texts, split)]
        counts = [len(e) for e in self.t.encode_batch_fast(rest, add_special_tokens=False)]
        return [n if w is None else n - self.feed + sum(map(known.get, w, repeat(0))) for n, w in zip(counts, split)]


def _count_whole(path: str):
    def run(batches):
        count = WordCounter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [c for k in range(0, len(texts), 256) for c in count(texts[k:k + 256])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(x.encode()) for x in texts], pa.int64()),
                 pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


CHUNK_SCHEMA = "tk struct<a: long, b: long>, idx int, last boolean, start long, end long, piece string"
SPLIT_SCHEMA = ("tk struct<a: long, b: long>, idx int, last boolean, n long, "
                "head array<struct<at: long, before: long>>, tail array<struct<at: long, before: long>>")


def _chunks(chunk: int, overlap: int):
    def run(batches):
        for b in batches:
            for tk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = cut(len(text), chunk, overlap)
                for k in range(0, len(spans), 64):
                    part = spans[k:k + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tk] * len(part), b.schema.field(0).type),
                         pa.array(range(k, k + len(part)), pa.int32()),
                         pa.array([e == len(text) for _, e in part]), pa.array([s for s, _ in part], pa.int64()),
                         pa.array([e for _, e in part], pa.int64()), pa.array([text[s:e] for s, e in part])],
                        names=["tk", "idx", "last", "start", "end", "piece"])

    return run


def _encode_chunks(path: str, overlap: int):
    def run(batches):
        t = load(path, True)
        kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
        for b in batches:
            n, heads, tails = [], [], []
            for idx, last, start, end, piece in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                e = t.encode(piece, add_special_tokens=False)
                bounds = [(start + c, k) for c, k in word_bounds(e)]
                n.append(len(e))
                heads.append([] if idx == 0 else [{"at": c, "before": k} for c, k in bounds if c < start + overlap])
                tails.append([] if last else [{"at": c, "before": k} for c, k in bounds
                                              if end - overlap <= c <= end - EDGE])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(heads, kind),
                 pa.array(tails, kind)], names=["tk", "idx", "last", "n", "head", "tail"])

    return run


def _splice(parts: DataFrame) -> DataFrame:
    """(tk, n_tokens) per document; null where a pair of neighbours does not align."""
    right = parts.select("tk", (F.col("idx") - 1).alias("idx"), F.col("head").alias("next_head"))
    pairs = parts.select("tk", "idx", "tail").join(right, ["tk", "idx"])
    # the first place that both have
    at = F.array_min(F.array_intersect(F.transform("tail", lambda x: x["at"]), F.transform("next_head", lambda x: x["at"])))
    pairs = pairs.withColumn("at", at)
    here = lambda col: F.array_min(F.filter(col, lambda x: x["at"] == F.col("at")))["before"]
    cuts = pairs.select("tk", "idx", here("tail").alias("upto"), here("next_head").alias("skipped"))
    # tokens of a document: each chunk up to its cut, less what the cut before it skips
    whole = parts.select("tk", F.when(F.col("last"), F.col("n")).otherwise(F.lit(0)).alias("n"), F.lit(0).alias("bad"))
    moved = cuts.select("tk", F.coalesce(F.col("upto") - F.col("skipped"), F.lit(0)).alias("n"),
                        F.col("upto").isNull().cast("int").alias("bad"))
    total = whole.unionByName(moved).groupBy("tk").agg(F.sum("n").alias("n"), F.max("bad").alias("bad"))
    return total.select("tk", F.when(F.col("bad") == 0, F.col("n")).alias("n_tokens"))


def _count_huge(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    todo, done, width = huge.select("tk", "text").dropDuplicates(["tk"]), None, overlap
    # a number of its own: the tasks are long for their bytes and must not be merged
    tasks = int(huge.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        whole = width >= chunk
        pieces = todo.mapInArrow(_chunks(1 << 62 if whole else chunk, 0 if whole else width), CHUNK_SCHEMA)
        parts = written(pieces.repartition(tasks, "tk", "idx").mapInArrow(_encode_chunks(path, width), SPLIT_SCHEMA), "chunks")
        spliced = _splice(parts)
        fine = spliced.filter("n_tokens is not null")
        done = fine if done is None else done.unionByName(fine)
        failed = spliced.filter("n_tokens is null").select("tk")
        if whole or failed.isEmpty():
            break
        todo = todo.join(sized(failed, 64), "tk", "left_semi")
        width *= WIDEN
    sizes = huge.select("doc_id", "tk", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(done, "tk").select("doc_id", "n_bytes", "n_tokens")
