import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_operators():
    for path in [*(ROOT / "tempora").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts and path.exists():
            assert "tempora.llm" not in path.read_text(), path


def test_imports_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tempora", tmp_path / "tempora", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'interval_union' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
