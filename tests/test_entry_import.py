"""The entry module must import and build its query and oracle tables anywhere:
no jar lookup, no JVM, no session."""

import glob
import importlib
import zipfile


def test_entry_builds_without_jar_lookup(monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("no archive is read to build the queries")
    monkeypatch.setattr(glob, "glob", lambda *a, **k: [])
    monkeypatch.setattr(zipfile, "ZipFile", refuse)
    from captionflow.functions import stopwords
    stopwords.base_list.cache_clear()
    stopwords.stopword_rows.cache_clear()
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert "segment_topics" in entry.queries()
    sql = entry.oracle_sql()
    assert "stopword rows" not in sql["stopword_sets"] and "('pt', " in sql["stopword_sets"]


def test_entry_without_and_with_a_broken_subpackage(tmp_path):
    """Without the optional subpackage the entry imports; with a broken one it fails."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/captionflow", tmp_path / "captionflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = [sys.executable, "-c", "import __spark_entry__ as E; print(len(E.queries()), any(k.startswith('op') for k in E.queries()))"]

    def out():
        return subprocess.run(run, cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert out().stdout.split()[1] == "False"
    (tmp_path / "captionflow/llm/__pycache__").mkdir(parents=True)
    assert out().stdout.split()[1] == "False"
    (tmp_path / "captionflow/llm/__init__.py").touch()
    (tmp_path / "captionflow/llm/registry.py").write_text("import no_such_module\n")
    assert out().returncode != 0 and "no_such_module" in out().stderr
