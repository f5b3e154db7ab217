"""Every registered query with oracle SQL equals DuckDB on the same tables (sf0.001)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from askbase.plans.oracle import oracle_sql as registry_oracle  # noqa: E402
from askbase.plans.registry import queries as registry_queries  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402

# the training-data operators have tests of their own
NAMES = sorted(registry_oracle())


@pytest.fixture(scope="module")
def con(sf):
    import duckdb
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


PYTHON_NODES = ("EvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf, con, name):
    df = E.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    plan = plan_text(df)
    # SQL-checked operators are native: no Python node, no cartesian product
    assert not any(n in plan for n in PYTHON_NODES), name
    assert "CartesianProduct" not in plan, name
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_every_query_has_oracle_or_is_declared_rows_only():
    rows_only = {"fuzzy_gate_many", "answer_questions_trained", "train_best_checkpoint"}
    assert set(registry_queries()) - set(registry_oracle()) == rows_only


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "answer" in df.columns
