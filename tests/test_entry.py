"""The library stands alone: the entry works in a copy without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "from __spark_entry__ import oracle_sql, queries; print(len(queries()), len(oracle_sql()), 'pipeline' in queries())"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_training_data_operators(tmp_path, pipeline):
    shutil.copytree(f"{ROOT}/veilspark", tmp_path / "veilspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py")[:1 + pipeline]:
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    env = {**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    run = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    n, n_sql, piped = run.stdout.split()
    assert int(n) >= int(n_sql) > 100 and piped == "False"
