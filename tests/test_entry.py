"""The entry points, and that the rest does without the removable parts."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry_points

from .conftest import SMALL

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert entry_points.entry(spark).count() == 50


def test_sql_belongs_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_some_queries_run(spark):
    known = entry_points.queries()
    for name in ("e05_needs_scripts", "c01_normalize", "s20_s21_score", "i16_site_audit", "r01_fusion", "k03_health", "e37_read_llm"):
        assert known[name](spark, SMALL).count() > 0, name


def test_without_the_removable_parts(tmp_path):
    shutil.copytree(os.path.join(TOP, "loomspan"), tmp_path / "loomspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(TOP, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not [k for k in e.queries() if k == 'pipeline' or k.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
