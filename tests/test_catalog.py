"""Every registered query against its SQL on the smallest tables, and the optional parts' absence."""

import glob
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from quillspark import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        made.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return made


def rows(frame):
    plain = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables missing")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.ORACLES[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables missing")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_works_without_the_optional_parts(tmp_path):
    shutil.copytree(f"{ROOT}/quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries().keys() >= e.oracle_sql().keys(); assert 'pipeline' not in e.queries(); print(len(e.queries()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
