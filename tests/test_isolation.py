"""The timeline engine stands without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_llm():
    for path in (ROOT / "timelode").rglob("*.py"):
        if "llm" not in path.parts:
            assert "timelode.llm" not in path.read_text(), path


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "timelode", tmp_path / "timelode", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'greedy_nms' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_entry_with_a_part_that_cannot_be_imported(tmp_path):
    """A folder that is left over, or a library that the part needs and that is missing."""
    shutil.copytree(ROOT / "timelode", tmp_path / "timelode", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'greedy_nms' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
    (tmp_path / "timelode" / "llm" / "__pycache__").mkdir(parents=True)
    run()
    (tmp_path / "timelode" / "llm" / "queries.py").write_text("import no_such_library\n")
    run()
