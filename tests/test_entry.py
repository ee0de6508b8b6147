"""The entry works on a copy of the tree without the training-data operators."""

import shutil
import subprocess
import sys

import pytest

from conftest import ROOT
from rollbook.plans import all_oracles, all_queries

ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline", [False, True])
@pytest.mark.parametrize("leftover", [False, True])
def test_entry_without_the_operators(tmp_path, pipeline, leftover):
    """Also where the pipeline's file or an empty folder of the operators is left."""
    shutil.copytree(ROOT / "rollbook", tmp_path / "rollbook", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if leftover:
        (tmp_path / "rollbook" / "llm" / "__pycache__").mkdir(parents=True)
    if pipeline:
        (tmp_path / "corpus_pipeline.py").write_text("import rollbook.llm.near\n")
    ran = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert ran.returncode == 0, ran.stderr
    assert ran.stdout.split() == [str(len(all_queries())), str(len(all_oracles()))]
