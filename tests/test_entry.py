"""The entry module with and without the training-data part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import sys
import __spark_entry__ as entry
names = sorted(entry.queries())
assert not [n for n in names if n.startswith("op") and n[2:3].isdigit() or n == "pipeline"], names
assert set(entry.oracle_sql()) <= set(names)
from tapeloom.session import get_session
spark = get_session("entry", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
print("rows", entry.queries()["agg_conditional"](spark, sys.argv[1]).count())
"""


@pytest.mark.parametrize("gone", [["corpus_pipeline.py"], []], ids=["pipeline gone too", "pipeline file left"])
def test_repository_works_without_the_training_data_folders(tmp_path, folder, gone):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "__pycache__", "*.json", *gone)
    shutil.copytree(ROOT, copy, ignore=lambda path, names: {*skip(path, names), *({"llm"} & set(names))})
    done = subprocess.run([sys.executable, "-c", PROBE, folder], cwd=copy, capture_output=True, text=True, timeout=300,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0 and "rows" in done.stdout, done.stderr[-2000:]
