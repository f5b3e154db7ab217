"""Token-ID / binary output (operator 3): blocks of separately compressed documents.

File format, a folder with two Parquet tables (so Spark's commit protocol
covers lost executors and any store that Spark reads will do):

``dictionary``  one row: dict_hash (sha256 of the dictionary), width (bytes
    per id), end_id, bytes.  The zstandard dictionary is trained on the
    serialized id arrays of a sample bounded by ``dict_docs`` documents of at
    most ``dict_chars`` code points; it changes the size, never the content.
``blocks``  shard, block, dict_hash, start (ids of the shard before the
    block), first_id, last_id, doc_ids, offsets (len + 1), counts, payload.
    payload holds one zstandard frame per document; document i of the block is
    payload[offsets[i]:offsets[i + 1]], so a short document is read without
    its neighbours (``read_documents``).  Shards follow ascending doc_id.

Ids come from the tokenizers library.  The normalizer and pre-tokenizer of
the word-level file never join text across ASCII white space, so a text's
ids are the ids of its white-space-separated pieces; every task keeps the
pieces and words it has seen, in tables bounded by twice ``CACHE_PIECES``
and ``CACHE_WORDS``.  Texts with control characters that Python and the library
split differently are encoded whole.

Edge cases: null text is an empty document (its end id only); null doc_ids
sort first; repeated rows are written as often as they come, in the order of
their text hash; an empty table gives a dictionary and no blocks.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache
from operator import add

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from askbase.llm.common import hash_sample, text_key
from askbase.llm.token_counts import load

CACHE_PIECES, CACHE_WORDS, PIECE_CHARS = 100_000, 150_000, 64
BLOCK_BYTES, LEVEL = 4 << 20, 3
DICT_DOCS, DICT_CHARS, DICT_BYTES = 2_000, 16_384, 112_640
#: str.split() breaks at these, the library's \s does not.
_ODD = re.compile("[\x1c-\x1f]")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
BLOCKS = ("shard int, block int, dict_hash string, start long, n_ids long, first_id long, last_id long, "
          "doc_ids array<long>, offsets array<int>, counts array<long>, payload binary")
DICTIONARY = "dict_hash string, width int, end_id long, bytes binary"


class Recent:
    """A table of what was used of late: two generations of at most ``half`` entries
    before a call.  What is used moves to the young one; the old one goes when that is full."""

    def __init__(self, half: int):
        self.half, self.young, self.old = half, {}, {}

    def turn(self) -> None:
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}

    def missing(self, keys: set) -> set:
        """Keys that are in neither; the others are young from now on."""
        keys = keys.difference(self.young)
        absent = keys.difference(self.old)
        for k in keys - absent:
            self.young[k] = self.old[k]
        return absent


@cache
def bare_model(path: str):
    """The same model without the steps before it, for words that are normalized
    already, and which ids end a word.  Once per Python worker."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    bare = Tokenizer.from_file(path)
    bare.normalizer = normalizers.Sequence([])
    bare.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocab = bare.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
    return bare, ends


class PieceEncoder:
    """Serialized ids (little-endian unsigned 32-bit) of texts, through bounded
    tables of pieces and of the lower-cased words in them."""

    def __init__(self, path: str):
        self.t = load(path)
        self.bare, self.ends = bare_model(path)
        # of this task only: they go when it ends
        self.pieces, self.words = Recent(CACHE_PIECES), Recent(CACHE_WORDS)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of letters; a word's last token, and no other, has
        the model's end-of-word mark."""
        out: list[bytes] = []
        for k in range(0, len(words), 1000):
            part = words[k:k + 1000]
            e = self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.asarray(e.ids, "<u4")
            raw, at = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            assert len(at) == len(part)
            out += map(raw.__getitem__, map(slice, [0, *at[:-1]], at))
        return out

    def _new_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces.  Latin-1 letters with ASCII marks other than an apostrophe
        behind are two matches of the pre-tokenizer at most, the first lower-cased."""
        heads, tails, whole = [], [], []
        for p in pieces:
            word = p.rstrip(_MARKS)
            if word.isalpha() and (word.isascii() or max(word) < "\u0100"):
                heads.append(word.lower())
                tails.append(p[len(word):])
            else:
                whole.append(p)
                heads.append("")
                tails.append(p)
        words = self.words
        words.turn()
        new = [w for w in words.missing(set(heads)) if w]
        fresh = dict(zip(new, self._encode_words(new))) if new else {}
        words.young.update(fresh)
        words.young[""] = b""
        rest = list({*tails, *whole})
        other = dict(zip(rest, self._encode(rest)))
        out = dict(zip(pieces, map(add, map(words.young.__getitem__, heads), map(other.__getitem__, tails))))
        _drop_long(words.young, fresh)
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        used: set[str] = set()
        self.pieces.turn()
        for text in texts:
            pieces = None if _ODD.search(text) else text.split()
            split.append(pieces)
            if pieces:
                used |= {*pieces}.difference(self.pieces.young)
        absent = self.pieces.missing(used)
        seen = self.pieces.young
        fresh = self._new_pieces(list(absent)) if absent else {}
        seen.update(fresh)
        get = seen.__getitem__
        out = [self._encode([t])[0] if s is None else b"".join(map(get, s)) for t, s in zip(texts, split)]
        _drop_long(seen, fresh)
        return out


def _drop_long(table: dict, fresh: dict) -> None:
    if max(map(len, fresh), default=0) > PIECE_CHARS:
        for k in fresh:
            if len(k) > PIECE_CHARS:
                del table[k]


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, width: int) -> bytes:
    """A dictionary from the serialized ids of about ``DICT_DOCS`` short documents,
    chosen by the hash of their text.  Too few of them: no dictionary (empty)."""
    short = docs.select("text").filter(F.length("text") <= DICT_CHARS)
    sample = hash_sample(short, "text", DICT_DOCS, docs.count(), seed=5)

    def run(batches):
        encode = PieceEncoder(tokenizer_path)
        for b in batches:
            ids = encode(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([narrow(x, end_id, width) for x in ids], pa.binary())], ["ids"])

    # copies of one text all have the same hash: distinct keeps the sample bounded
    got = sample.distinct().mapInArrow(run, "ids binary").limit(2 * DICT_DOCS).collect()
    samples = sorted(bytes(r["ids"]) for r in got)
    try:
        size = min(DICT_BYTES, max(256, sum(map(len, samples)) // 10))
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def narrow(ids: bytes, end_id: int, width: int) -> bytes:
    """Ids with the end id, ``width`` bytes each."""
    a = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
    return a.astype(f"<u{width}").tobytes()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode and write every row of ``docs`` in ascending doc_id order."""
    spark = docs.sparkSession
    width = 2 if max(load(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    trained = train_dictionary(docs, tokenizer_path, end_id, width)
    name = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(name, width, end_id, bytearray(trained))], DICTIONARY).coalesce(1).write.parquet(
        f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(trained)   # at most DICT_BYTES

    def run(batches):
        encode = PieceEncoder(tokenizer_path)
        d = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True).compress
        out = _Blocks(TaskContext.get().partitionId(), name)
        for b in batches:
            ids_in, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(0, len(texts), 256):
                part = encode(texts[k:k + 256])
                for doc_id, raw in zip(ids_in[k:k + 256], part):
                    if out.add(doc_id, len(raw) // 4 + 1, pack(narrow(raw, end_id, width))):
                        yield out.flush()
        if out.doc_ids:
            yield out.flush()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", text_key()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


class _Blocks:
    def __init__(self, shard: int, name: str):
        self.shard, self.name, self.block, self.start = shard, name, 0, 0
        self._clear()

    def _clear(self):
        self.doc_ids, self.counts, self.offsets, self.frames = [], [], [0], []

    def add(self, doc_id, n, frame) -> bool:
        self.doc_ids.append(doc_id)
        self.counts.append(n)
        self.frames.append(frame)
        self.offsets.append(self.offsets[-1] + len(frame))
        return self.offsets[-1] >= BLOCK_BYTES

    def flush(self) -> pa.RecordBatch:
        n = sum(self.counts)
        known = [x for x in self.doc_ids if x is not None]
        cols = [([self.shard], pa.int32()), ([self.block], pa.int32()), ([self.name], pa.string()),
                ([self.start], pa.int64()), ([n], pa.int64()), ([known[0] if known else None], pa.int64()),
                ([known[-1] if known else None], pa.int64()), ([self.doc_ids], pa.list_(pa.int64())),
                ([self.offsets], pa.list_(pa.int32())), ([self.counts], pa.list_(pa.int64())),
                ([b"".join(self.frames)], pa.binary())]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols], names=names)
        self.block, self.start = self.block + 1, self.start + n
        self._clear()
        return out


def read_dictionary(spark: SparkSession, path: str):
    r = spark.read.schema(DICTIONARY).parquet(f"{path}/dictionary").first()
    return r["dict_hash"], r["width"], bytes(r["bytes"] or b"")


def _decoder(trained: bytes, name: str, width: int):
    assert hashlib.sha256(trained).hexdigest() == name, "the dictionary is not the one that the blocks name"
    d = zstandard.ZstdCompressionDict(trained) if trained else None
    unpack = zstandard.ZstdDecompressor(dict_data=d).decompress
    return lambda frame: np.frombuffer(unpack(frame), f"<u{width}").astype("<u4")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    name, width, trained = read_dictionary(spark, path)
    shared = spark.sparkContext.broadcast(trained)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # one row per shard (a task's output) reaches the driver
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    base, total = [], 0
    for r in shards:
        base.append((r["shard"], total))
        total += r["n"]
    bases = F.broadcast(spark.createDataFrame(base, "shard int, base long"))

    def run(batches):
        decode = _decoder(shared.value, name, width)
        for b in batches:
            for r in b.to_pylist():
                assert r["dict_hash"] == name
                at, starts, crcs = r["base"] + r["start"], [], []
                payload, offs = r["payload"], r["offsets"]
                for i, n in enumerate(r["counts"]):
                    ids = decode(payload[offs[i]:offs[i + 1]])
                    assert len(ids) == n
                    starts.append(at)
                    crcs.append(zlib.crc32(ids.tobytes()))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(r["counts"], pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(bases, "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents: blocks are skipped by their id range, and
    in a block only the frames asked for are decompressed."""
    name, width, trained = read_dictionary(spark, path)
    wanted = set(doc_ids)
    near = F.lit(False)
    for d in sorted(wanted):
        near = near | ((F.col("first_id") <= d) & (F.col("last_id") >= d))

    def run(batches):
        decode = _decoder(trained, name, width)
        for b in batches:
            for r in b.to_pylist():
                at = [i for i, d in enumerate(r["doc_ids"]) if d in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["doc_ids"][i] for i in at], pa.int64()),
                     pa.array([decode(r["payload"][r["offsets"][i]:r["offsets"][i + 1]]).tolist() for i in at],
                              pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").filter(near).mapInArrow(
        run, "doc_id long, ids array<long>")
