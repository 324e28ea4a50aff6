"""The entry point where parts of it can't be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("hidden", ["tallylog.llm", "xxhash", "tokenizers", "public_tokenizers", "corpus_pipeline"])
def test_other_queries_work_without(hidden):
    code = f"""
import sys
sys.modules[{hidden!r}] = None
import __spark_entry__ as entry
from tallylog import catalog
found = entry.queries()
assert set(catalog.QUERIES) <= set(found) and set(entry.oracle_sql()) <= set(found)
assert "pipeline" not in found
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=120)
