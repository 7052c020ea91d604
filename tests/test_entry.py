"""The entry file, with and without the llm subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["sample", "kmer", "cnt"]


def test_imports_without_llm(tmp_path):
    (tmp_path / "strandworks").mkdir()
    for p in (ROOT / "strandworks").rglob("*.py"):
        if "llm" not in p.parts:
            out = tmp_path / p.relative_to(ROOT)
            out.parent.mkdir(parents=True, exist_ok=True)
            out.write_text(p.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 50 and said.stdout.split()[1] == "False"


def test_errors_inside_llm_are_not_hidden(tmp_path):
    for name, text in (("strandworks/__init__.py", ""), ("strandworks/plans/__init__.py", ""), ("strandworks/plans/queries.py", "QUERIES, SQL = {}, {}"), ("strandworks/llm/__init__.py", ""), ("strandworks/llm/queries.py", "import no_such_module_at_all")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert said.returncode != 0 and "no_such_module_at_all" in said.stderr


def test_nothing_else_imports_llm():
    for p in (ROOT / "strandworks").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p
