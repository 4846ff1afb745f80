"""The library stands without its optional parts."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_optional_parts(tmp_path):
    import shutil
    shutil.copytree(f"{ROOT}/postlens", tmp_path / "postlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = ("import __spark_entry__ as E; q, s = E.queries(), E.oracle_sql(); "
            "assert set(q) == set(s) and 'date_table' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_nothing_outside_imports_the_optional_parts():
    for folder, _, files in os.walk(f"{ROOT}/postlens"):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in folder:
                text = open(os.path.join(folder, f), encoding="utf-8").read()
                assert "postlens.llm" not in text and "corpus_pipeline" not in text
