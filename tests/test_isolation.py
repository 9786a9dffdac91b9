"""The library stands without its optional parts."""

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_entry_without_training_data_operators(tmp_path):
    for name in ("prosemill", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    # with a pipeline file left behind, and without
    (tmp_path / "corpus_pipeline.py").write_text("from prosemill.llm import jaccard\n")
    code = "import __spark_entry__ as e; names = set(e.queries()); assert len(names) > 40 and not [n for n in names if n.startswith('op') or n == 'pipeline'] and set(e.oracle_sql()) <= names"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
