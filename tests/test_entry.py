"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_optional_parts(tmp_path):
    """A checkout without the optional parts still has its other queries."""
    (tmp_path / "quantfield").mkdir()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    for p in (ROOT / "quantfield").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quantfield" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lorenzo1d_encode' in q and not [k for k in q if k.startswith('op1_')] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
