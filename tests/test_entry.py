"""The driver contract holds without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_loads_without_the_operators_of_training_data(tmp_path):
    def left_out(folder, names):
        return [n for n in names if n in ("llm", ".git", "__pycache__")]

    for kept_pipeline in (True, False):
        copy = tmp_path / str(kept_pipeline)
        shutil.copytree(ROOT, copy, ignore=left_out)
        if not kept_pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()))"
        told = subprocess.run(
            [sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=False
        )
        assert told.returncode == 0, told.stderr
        assert told.stdout.strip() in ("True", "False")
