"""The entry module without the optional parts."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT
from regiflow.queries import QUERIES

SAYS = "import __spark_entry__ as E; print(sorted(E.queries()) == sorted(E.oracle_sql()), len(E.queries()))"


def _copied(tmp_path, left_out):
    def ignore(folder, names):
        own = os.path.relpath(folder, ROOT)
        return [n for n in names if n in (".git", "__pycache__") or os.path.normpath(os.path.join(own, n)) in left_out]

    return shutil.copytree(ROOT, tmp_path / "copy", ignore=ignore)


def _said(folder, before=""):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", before + SAYS], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_without_the_optional_folders(tmp_path):
    """Both folders deleted, corpus_pipeline.py still there or deleted too."""
    folder = _copied(tmp_path, {"regiflow/llm", "tests/llm"})
    assert _said(folder) == ["True", str(len(QUERIES))]
    (folder / "corpus_pipeline.py").unlink()
    assert _said(folder) == ["True", str(len(QUERIES))]


def test_without_a_library_of_the_optional_folder(tmp_path):
    folder = _copied(tmp_path, set())
    broken = "import sys; sys.modules['public_tokenizers'] = None\n"
    assert _said(folder, broken) == ["True", str(len(QUERIES))]


def test_with_everything_the_optional_queries_are_there(tmp_path):
    assert int(_said(_copied(tmp_path, set()))[1]) > len(QUERIES)
