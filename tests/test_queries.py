"""Every registered query with SQL agrees with DuckDB at the smallest scale."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.plans import queries as core

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_against_sql(spark, db, name):
    assert rows(core.queries()[name](spark, SF).toPandas()) == rows(db.sql(core.oracle_sql()[name]).df())


def test_recall_and_entry(spark):
    assert core.ivf_recall(spark, SF).first().recall >= 0.9
    s = core._snapshot(spark, SF)
    few = core.recall(s, core._queries(spark, SF), len(s.centroids()) // 2).first()
    assert few.found < few.wanted and few.recall > 0.7
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "plumbline"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "plumbline/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_topk_batch' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
