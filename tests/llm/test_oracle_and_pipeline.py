"""Queries with SQL equal DuckDB; the pipeline equals its stages done plainly."""

import os
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import corpus_pipeline  # noqa: E402
from askbase.llm import decontaminate, oracle, quality_model, queries, token_counts  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402
from tests.llm.helpers import components, edge_docs, with_clashes  # noqa: E402


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_oracle(spark, sf, name):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    res = con.execute(oracle.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, res.fetchall())[0]


def test_all_operators_are_registered():
    import __spark_entry__ as E
    names = [n for n in E.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
    assert len(names) == 14 and {int(n[2:].split("_")[0]) for n in names if n != "pipeline"} == set(range(1, 14))


def test_pipeline_equals_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    model = quality_model.fit(docs, labels)
    good = {r["doc_id"] for r in quality_model.score(docs, model).collect() if r["kept"]}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    comp = components([(i, t) for i, t in text.items() if i in good], need=80, n=5)
    one = [i for i, (_, c) in comp.items() if c == i]
    windows = set()
    for r in bench.collect():
        w = decontaminate.words_of(r["text"])
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9)) if w}
    clean = []
    for i in one:
        w = decontaminate.words_of(text[i])
        if not any(tuple(w[k:k + m]) in windows for m in {len(x) for x in windows} for k in range(len(w) - m + 1)):
            clean.append(i)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(clean) and len(clean) < len(one) < len(good) < len(text)
    t = token_counts.load(public_tokenizers.path(queries.WORD_BPE))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        ids = t.encode(text[r["doc_id"]], add_special_tokens=False).ids + [queries.END_ID]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_stages_take_edge_cases(spark, sf):
    docs = with_clashes(edge_docs(spark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_near_duplicate_stage_equals_brute_force_of_five_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {i for i, (_, c) in components(rows, need=80, n=5).items() if c == i}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()} == want
    assert want != {i for i, (_, c) in components(rows).items() if c == i}


def test_pipeline_on_empty_tables(spark, sf, tmp_path):
    none, few = str(tmp_path / "none"), str(tmp_path / "few")
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        rows.limit(0).write.parquet(f"{none}/{name}.parquet")
        (rows.filter("doc_id < 40") if name == "documents" else rows.limit(0)).write.parquet(f"{few}/{name}.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, few).collect()]
    assert 0 < len(set(got)) <= 40 and set(got) <= set(range(40))
