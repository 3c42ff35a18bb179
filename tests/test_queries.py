"""Every registered query against its SQL in DuckDB on the smallest table, and the package without the training-data operators."""

import glob
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessitura.plans.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return 0.0 if isinstance(v, float) and (v == 0 or math.isnan(v)) else v


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = tables.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@needs_tables
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


@needs_tables
def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "tessitura"):
        subprocess.run(["cp", "-r", ROOT / name, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "tessitura/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 50 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_plans_push_down_and_prune(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("needs the driver's tables")
    plan = QUERIES["pitch_range"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_retailprice:double>" in plan
    plan = QUERIES["device_lookup"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
