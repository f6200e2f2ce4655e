"""Queries without SQL run to their end, in workers too, which may import any module of queries first."""

import subprocess
import sys
from pathlib import Path

import pytest

from marketloom.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert len(catalog.queries()[name](spark, D).collect()) > 0


@pytest.mark.parametrize("module", ["base", "catalog", "extended", "indexed", "simulated", "stored", "streamed"])
def test_imports_alone(module):
    done = subprocess.run([sys.executable, "-c", f"import marketloom.plans.{module}"], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
