import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["url", "ptl", "rptl", "rptl_norm", "nl", "rnl", "rnl_norm", "lts", "lts_norm"]
    assert df.count() > 0


def test_sql_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_library_stands_without_the_subpackage(tmp_path, pipeline):
    """The subpackage is gone; the pipeline that imports it may be there or gone too."""
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        (tmp_path / name).symlink_to(REPO / name)
    package = tmp_path / "tarnkite"
    package.mkdir()
    for p in (REPO / "tarnkite").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    many, sql = map(int, said.stdout.split())
    assert many > 70
    assert sql > 70
    (tmp_path / "tests").mkdir()
    for p in ("conftest.py", "test_functions.py"):
        (tmp_path / "tests" / p).write_text((REPO / "tests" / p).read_text())
    said = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests"], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert said.returncode == 0, said.stdout
