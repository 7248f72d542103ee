"""The driver's contract, and that the library stands without its optional subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p3_found", "p4_found"} <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 10 and df.columns == ["label", "d", "pr", "iso_score", "vmf_kappa"]


def test_nothing_but_the_entry_point_names_the_optional_subpackage():
    found = [p for p in ROOT.glob("vecloom/**/*.py") if "llm" not in p.relative_to(ROOT).parts and re.search(r"\bllm\b", p.read_text())]
    assert found == []


def test_imports_without_it():
    code = "import sys; sys.modules['vecloom.llm'] = None; import vecloom.plans.catalog as c; print(len(c.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) > 40
