"""The driver contract with and without the training-data part."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as driver

ROOT = Path(__file__).parent.parent


def test_names():
    names = driver.queries()
    assert {"q_degrees", "q_clustering"} <= set(names) and set(driver.oracle_sql()) <= set(names)


@pytest.mark.parametrize("missing", ["ahocorasick", "tallygraph.llm", "corpus_pipeline"])
def test_core_queries_without(missing):
    code = f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; print(len([q for q in e.queries() if q.startswith('q_')]), 'pipeline' in e.queries(), any(q.startswith('op') for q in e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert int(said[0]) == len([q for q in driver.queries() if q.startswith("q_")]) and said[1:] == ["False", "False"]
