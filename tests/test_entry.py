"""Queries against DuckDB, and the guard around the optional subpackage."""

import os
import re
import subprocess
import sys

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
import __spark_entry__ as entry  # noqa: E402
from maskweave import queries as core  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_oracle(spark, duck, name):
    df = core.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    theirs = sorted(repr(tuple(dict(zip(rel.columns, r, strict=True))[c] for c in cols)) for r in rel.fetchall())
    assert mine == theirs


def test_entry_imports_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()); print(len(e.queries()))"
    root = os.path.dirname(entry.__file__)
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, env=os.environ | {"PYTHONPATH": root}).returncode == 0


def test_nothing_else_imports_the_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "maskweave")
    for d, _, names in os.walk(root):
        if "llm" not in d.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"(from|import)\b.*\bllm\b", open(os.path.join(d, n)).read()), n
