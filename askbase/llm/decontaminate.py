"""Benchmark decontamination (operator 4): Wu-Manber search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark
items; an item of fewer words is one pattern.  Per pattern length the tables
are: shift (last two words of a window -> how far the search may move without
passing an occurrence), buckets (pairs with shift 0 -> patterns that end in
them), and the direct comparison that confirms.  A pair that no pattern holds
skips a whole window less one word.

Words are maximal runs of bytes outside ASCII punctuation and space after
A-Z are lower-cased, so any non-ASCII character belongs to a word.

Edge cases: null texts have no words; items with a null id mark hits but name no item;
repeated item rows count once; rows of documents are searched one by one, so
repeated rows and null ids give their own rows; extra columns are ignored.

Size: the tables go to the executors only as far as their measured bytes
stay under ``table_bytes``; a larger benchmark is searched in slices of items,
one pass over the documents each, and the hits are united.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from askbase.llm.common import text_key

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, n_words long, hits array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WuManber:
    """Tables for patterns (tuples of words) of one length."""

    def __init__(self, length: int, patterns: dict[tuple, set[str]]):
        self.m, self.b = length, min(2, length)
        self.skip = length - self.b + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list[tuple]] = {}
        self.patterns = patterns
        for p in patterns:
            for end in range(self.b, length + 1):
                block, move = p[end - self.b:end], length - end
                if move < self.shift.get(block, self.skip):
                    self.shift[block] = move
            self.bucket.setdefault(p[-self.b:], []).append(p)

    def ends(self, words: list[bytes]):
        """(end, pattern) of every occurrence."""
        m, b, skip, shift, bucket = self.m, self.b, self.skip, self.shift.get, self.bucket
        end, n = m, len(words)
        while end <= n:
            block = tuple(words[end - b:end])
            move = shift(block, skip)
            if move:
                end += move
                continue
            at = tuple(words[end - m:end])
            for p in bucket[block]:
                if p == at:
                    yield end, p
            end += 1


def build(items: list[tuple[str | None, str | None]], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple, set[str]]] = {}
    for item_id, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            ids = by_length.setdefault(m, {}).setdefault(tuple(words[i:i + m]), set())
            if item_id is not None:
                ids.add(item_id)
    return [WuManber(m, p) for m, p in sorted(by_length.items())]


def search(words: list[bytes], tables: list[WuManber]) -> tuple[set[int], set[str]]:
    hit: set[int] = set()
    items: set[str] = set()
    for t in tables:
        for end, p in t.ends(words):
            hit.update(range(end - t.m, end))
            items |= t.patterns[p]
    return hit, items


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                   table_bytes: int = 16 << 20, carry_key: bool = False) -> DataFrame:
    """(doc_id, n_words, hits, items) per row: positions of hit words, ascending,
    and ids of the items that occur, as sorted strings.  With ``carry_key`` also
    the row's ``text_key`` as tk."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    # a word of a text is in at most `window` windows
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] * window
    slices = max(1, -(-size // table_bytes))
    keyed = carry_key or slices > 1
    rows = docs.select("doc_id", "text", text_key().alias("tk")) if keyed else docs.select("doc_id", "text")
    found = None
    for k in range(slices):
        part = items if slices == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)
        tables = spark.sparkContext.broadcast(build([tuple(r) for r in part.distinct().collect()], window))
        one = _search_pass(rows, tables, keyed)
        found = one if found is None else found.unionByName(one)
    if slices == 1:
        return found
    united = found.groupBy("doc_id", "tk", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count(F.lit(1)) / slices).cast("int").alias("copies"))
    out = ["doc_id", "n_words", "hits", "items", *(["tk"] if carry_key else [])]
    return united.select(*out, F.explode(F.sequence(F.lit(1), "copies"))).select(*out)


def _search_pass(docs: DataFrame, tables, with_key: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            n_words, hits, items = [], [], []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                h, i = search(words, tables.value)
                n_words.append(len(words))
                hits.append(sorted(h))
                items.append(sorted(i))
            cols = {"doc_id": b.column(0).cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()),
                    "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
            if with_key:
                cols["tk"] = b.column(2)
            yield pa.RecordBatch.from_pydict(cols)

    return docs.mapInArrow(run, SCHEMA + (", tk struct<a: long, b: long>" if with_key else ""))


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
