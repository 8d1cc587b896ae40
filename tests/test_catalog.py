"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return check.connect(FOLDER)


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "lang", "n_chars"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, db, name):
    assert check.compare(spark, db, FOLDER, name, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_no_python_functions_in_plans(spark):
    for name in ("k1_search", "g7_validate_and_enrich", "e4_case_hierarchy", "i2_average_speed", "h3_inverted_index"):
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_the_rest_works_without_the_optional_operators(tmp_path):
    """Copied without the subpackage, its tests and the pipeline, the entry imports and the tests are collected."""
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.json", "*.txt")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300, check=False)
    out = run("-c", code)
    assert out.returncode == 0 and out.stdout.split()[-1] == "False" and int(out.stdout.split()[-2]) > 150, out.stderr
    assert run("-m", "pytest", "tests", "--collect-only", "-q").returncode == 0
