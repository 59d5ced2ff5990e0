"""The entry module without the training-data subpackage, as a copy that lacks it."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CHECK = """
import __spark_entry__ as e
queries, sql = e.queries(), e.oracle_sql()
assert len(queries) > 200 and set(sql) <= set(queries), len(queries)
assert not [q for q in queries if q == "pipeline" or q[:2] == "op" and q[2:3].isdigit()]
"""


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_rest_works_without_the_subpackage(tmp_path, also):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", *also))
    path = os.pathsep.join(x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and os.path.abspath(x) != ROOT)
    env = os.environ | {"PYTHONPATH": path}
    done = subprocess.run([sys.executable, "-c", CHECK], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    rest = [f"tests/{x}" for x in sorted(os.listdir(copy / "tests")) if x.startswith("test_") and x not in ("test_entry.py", "test_oracles.py")]
    run = subprocess.run([sys.executable, "-m", "pytest", *(["tests", "--collect-only"] if also else rest), "-q", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stdout[-2000:]
