"""The driver's entry: core keys whatever becomes of the training-data part."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("hidden", [[], ["zstandard"], ["tallyspark.llm"], ["corpus_pipeline"], ["regex", "tokenizers"]])
def test_core_queries_are_there_without_a_library_or_the_subpackage(hidden):
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        f"for name in {hidden!r}: sys.modules[name] = None\n"
        "import __spark_entry__ as E\n"
        "from tallyspark.plans import QUERIES, ORACLES\n"
        "assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())\n"
        "assert set(E.oracle_sql()) <= set(E.queries())\n"
        "print(len(E.queries()) - len(QUERIES))"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT)
    assert done.returncode == 0, done.stderr
    extra = int(done.stdout.split()[-1])
    if hidden in (["zstandard"], ["tallyspark.llm"]):
        assert extra == 0
