"""Without the corpus subpackage, with or without its pipeline, the rest imports and has its queries."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_it(tmp_path, pipeline):
    copy = tmp_path / "repo"
    copy.mkdir()
    shutil.copytree(f"{ROOT}/suitestat", copy / "suitestat", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        shutil.copy(f"{ROOT}/{name}", copy / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=env, capture_output=True, text=True)
    n, corpus = out.stdout.split()[-2:]
    assert int(n) > 100 and corpus == "False", out.stderr
