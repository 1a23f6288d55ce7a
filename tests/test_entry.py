"""The driver's contract, and queries without SQL against plain computations."""

import os
import shutil
import subprocess
import sys

import __spark_entry__
import pytest
from docdelta.plans import registry

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["chapter", "added", "deleted", "changed", "total"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("how", ["deleted", "broken"])
def test_a_copy_without_the_training_data_package(tmp_path, how):
    """With its folders deleted, or a package it needs missing, all other queries are there."""
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    if how == "deleted":
        for gone in ("docdelta/llm", "tests/llm"):
            shutil.rmtree(at / gone, ignore_errors=True)
        (at / "corpus_pipeline.py").unlink(missing_ok=True)
    else:
        (at / "xxhash.py").write_text("raise ImportError('not installed')\n")
    done = subprocess.run([sys.executable, "-c", LIST], cwd=at, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(at)})
    assert done.returncode == 0, done.stderr
    queries, oracles = (set(x.split()) for x in done.stdout.split("|"))
    assert queries == set(registry.queries()) and oracles == set(registry.oracle_sql())


@pytest.mark.parametrize("name", ["similarity_residual", "outline_anchors"])
def test_queries_do_not_depend_on_partitions(spark, name):
    rows = lambda: sorted(map(str, registry.queries()[name](spark, SF).collect()))
    first = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows() == first and first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
