"""The entry module without the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

CODE = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(q for q in e.queries() if q.startswith('op') or q == 'pipeline'))"


@pytest.mark.parametrize("without", [["sentrylake/llm"], ["sentrylake/llm", "corpus_pipeline.py"]])
def test_entry_without_the_subpackage(tmp_path, without):
    from sentrylake.plans.catalog import ORACLES, QUERIES

    gone = [str(ROOT / name) for name in without]
    ignore = lambda folder, names: [n for n in names if n.startswith(".") or f"{folder}/{n}" in gone or n in ("tests", "__pycache__")]
    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignore)
    ran = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "copy", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert ran.returncode == 0, ran.stderr
    assert ran.stdout.split("\n")[0] == f"{len(QUERIES)} {len(ORACLES)} []"
