"""The keyed unknown table: writers side by side, pruned reads, lost and foreign files."""

import pytest
from pyspark.sql import functions as F

from askbase.operators import unknowns as U
from askbase.session import scratch_path
from askbase.sources import unknown_store as US
from askbase.sources.commit_log import CommitLog
from askbase.sources.unknown_store import UnknownStore


def asked(spark, texts, start=0):
    return spark.createDataFrame([(t, start + i) for i, t in enumerate(texts)], "question string, arrival long")


def content(store):
    return sorted((r["id"], r["question"]) for r in store.scan().collect())


def test_insert_is_idempotent_and_dense(spark):
    store = UnknownStore(spark, scratch_path(spark, "t-store"))
    assert content(store) == []
    assert [r["question"] for r in store.insert_absent(asked(spark, ["b", "a", None, "b", "A"])).orderBy("id").collect()] == ["b", "a", "A"]
    assert store.insert_absent(asked(spark, ["a", "b"])).count() == 0
    assert [tuple(r) for r in store.insert_absent(asked(spark, ["c", "a", ""])).orderBy("id").collect()] == [(4, "c", None), (5, "", None)]
    assert content(store) == [(1, "b"), (2, "a"), (3, "A"), (4, "c"), (5, "")]
    assert store.insert_absent(asked(spark, [])).count() == 0


def test_two_writers_at_once(spark, monkeypatch):
    """The second to publish finds its version taken, leaves out what the first stored, and takes the next ids."""
    path = scratch_path(spark, "t-store")
    one, other = UnknownStore(spark, path), UnknownStore(spark, path)
    one.insert_absent(asked(spark, ["old"]))
    plain, calls = one.log.publish, []

    def publish(version, manifest):
        calls.append(version)
        if len(calls) == 1:
            other.insert_absent(asked(spark, ["x", "both", "y"]))
        if len(calls) == 2:
            other.insert_absent(asked(spark, ["z"]))      # no question in common: ids move on, nothing is prepared anew
        return plain(version, manifest)

    monkeypatch.setattr(one.log, "publish", publish)
    added = one.insert_absent(asked(spark, ["both", "mine", "old"]))
    assert [tuple(r) for r in added.collect()] == [(6, "mine", None)]
    assert calls == [2, 3, 4]
    assert content(one) == [(1, "old"), (2, "x"), (3, "both"), (4, "y"), (5, "z"), (6, "mine")]


def test_one_version_has_one_winner(spark):
    log = CommitLog(spark, scratch_path(spark, "t-log"))
    assert log.latest() == (0, None)
    assert log.publish(1, {"a": 1}) and not log.publish(1, {"a": 2})
    assert log.latest() == (1, {"a": 1}) and log.publish(2, {"ş": "ı"}) and log.latest() == (2, {"ş": "ı"})
    assert log.versions() == [1, 2] and log.published(2) and not log.published(3)


def test_reads_touch_asked_buckets_only(spark):
    store = UnknownStore(spark, scratch_path(spark, "t-store"), buckets=16)
    store.insert_absent(asked(spark, [f"q{i}" for i in range(200)]))
    stored = store._rows(store.state()[1]["commits"], [3, 7])
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {r["bucket"] for r in stored.collect()} == {3, 7}
    whole = store._rows(store.state()[1]["commits"])
    assert stored.count() < whole.count() == 200


def test_commits_are_compacted_and_vacuumed(spark, monkeypatch):
    monkeypatch.setattr(US, "COMPACT_AFTER", 3)
    store = UnknownStore(spark, scratch_path(spark, "t-store"), buckets=4)
    for i in range(5):
        store.insert_absent(asked(spark, [f"q{i}", "again"]))
    want = [(1, "q0"), (2, "again"), (3, "q1"), (4, "q2"), (5, "q3"), (6, "q4")]
    assert content(store) == want and len(store.state()[1]["commits"]) == 2
    assert store.vacuum() > 0 and content(store) == want and store.vacuum() == 0
    store.insert_absent(asked(spark, ["q3", "new"]))
    assert content(store) == want + [(7, "new")]


def test_replace_and_reset(spark):
    store = UnknownStore(spark, scratch_path(spark, "t-store"))
    US.write_unknown(spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, question string, answer string"), store.path)
    assert sorted(tuple(r) for r in US.scan_unknown(spark, store.path).collect()) == [(1, "a", "x"), (2, "b", None)]
    U.log_unknown(spark, asked(spark, ["b", "c"]), store.path)
    assert content(store) == [(1, "a"), (2, "b"), (3, "c")]
    assert US.reset_unknown(spark, store.path).count() == 0
    U.log_unknown(spark, asked(spark, ["c"]), store.path)
    assert content(store) == [(1, "c")]
    US.write_unknown(store.scan().limit(0), store.path)
    assert content(store) == [] and store.insert_absent(asked(spark, ["d"])).first()["id"] == 1


def test_a_hot_question_is_one_row(spark):
    store = UnknownStore(spark, scratch_path(spark, "t-store"))
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("question"),
                                      (F.col("id") + 1).alias("arrival"))
    assert store.insert_absent(rows).count() == 10_001
    ids = sorted(r["id"] for r in store.scan().collect())
    assert ids == list(range(1, 10_002))
    assert store.scan().filter("question = 'hot'").first()["id"] == 2


def test_files_that_no_commit_names_do_not_count_and_lost_ones_do(spark):
    import os
    store = UnknownStore(spark, scratch_path(spark, "t-store"), buckets=1)
    store.insert_absent(asked(spark, ["a", "b"]))
    folder = store.path.removeprefix("file:") + "/data"
    stray = folder + "/commit=stray/bucket=0"
    os.makedirs(stray)
    with open(stray + "/part-0.parquet", "wb") as f:
        f.write(b"not parquet")
    assert content(store) == [(1, "a"), (2, "b")]
    live = f"{folder}/commit={store.state()[1]['commits'][0]['name']}/bucket=0"
    part = next(f for f in os.listdir(live) if f.endswith(".parquet"))
    with open(f"{live}/{part}", "wb") as f:
        f.write(b"not parquet")
    if os.path.exists(f"{live}/.{part}.crc"):
        os.remove(f"{live}/.{part}.crc")
    with pytest.raises(Exception):
        store.insert_absent(asked(spark, ["c"]))
    assert len(store.state()[1]["commits"]) == 1
