"""The library without its llm subpackage and that one's tests: it imports, and registers what is left."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_without_llm(tmp_path):
    for name in ("spandrel", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if src.is_dir() else {}))
    (tmp_path / "spandrel" / "llm").mkdir()  # a left-over folder is no subpackage
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_imports_llm():
    for p in (ROOT / "spandrel").rglob("*.py"):
        if "llm" not in p.parts:
            assert "spandrel.llm" not in p.read_text(), p
