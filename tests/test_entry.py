import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [["octetloom/llm"], ["octetloom/llm", "corpus_pipeline.py"], []])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    for name in ("octetloom", "corpus_pipeline.py", "__spark_entry__.py"):
        if name not in gone and (ROOT / name).exists():
            copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
            copy(ROOT / name, tmp_path / name)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), sum(k.startswith('op') and k[2].isdigit() for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    number, known, training = out.stdout.split()
    there = (ROOT / "octetloom/llm").exists() and not gone
    assert int(number) > 60 and known == "True" and (int(training) == 10) == there


def test_a_broken_part_is_not_taken_for_a_missing_one(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path / "__spark_entry__.py")
    shutil.copytree(ROOT / "octetloom", tmp_path / "octetloom")
    (tmp_path / "corpus_pipeline.py").write_text("import not_there_at_all")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.returncode and "not_there_at_all" in out.stderr
