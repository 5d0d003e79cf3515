"""The rest of the library without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/motrac", tmp_path / "motrac", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'transition_matrix' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for d, _, names in os.walk(f"{ROOT}/motrac"):
        if "llm" not in d.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    with open(f"{d}/{n}") as f:
                        assert "motrac.llm" not in f.read(), n
