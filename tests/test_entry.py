"""The entry without the operators for training data, or without a package they need."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent

PROBE = """
import sys
sys.modules[MISSING] = None  # importing it fails
import __spark_entry__ as entry
from salesloom.plans import registry
assert set(entry.queries()) - {"pipeline"} == set(registry.jobs()) and len(entry.queries()) >= 45
assert set(entry.oracle_sql()) == set(registry.oracles())
"""


@pytest.mark.parametrize("missing", ["salesloom.llm", "ahocorasick", "tokenizers", "public_tokenizers", "zstandard"])
def test_other_jobs_are_served(missing):
    run = subprocess.run([sys.executable, "-c", f"MISSING = {missing!r}\n" + PROBE], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-2000:]


def test_nothing_else_imports_the_subpackage():
    for path in [*ROOT.glob("salesloom/**/*.py"), *ROOT.glob("tools/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            text = path.read_text()
            assert "salesloom.llm" not in text and "from ..llm" not in text and "from .llm" not in text, path
