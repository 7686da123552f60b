"""Every registered query of the library against DuckDB, and the entry module with and without the training-data part."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from ledgerlens.plans.registry import ORACLES, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None or v != v:
        return "NULL"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def _canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        columns = [c[0] for c in found.description]
        assert _canon(rows, df.columns) == _canon(found.fetchall(), columns)
    else:
        assert rows


def test_entry_module_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(QUERIES)), "False", "True"], said.stderr


def test_nothing_else_imports_the_training_data_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "ledgerlens")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, name)).read(), name
