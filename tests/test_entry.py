import subprocess
import sys
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_their_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "locked_counts" in entry.oracle_sql()


def test_entry_works_without_the_corpus_part(tmp_path):
    for name in ("__spark_entry__.py", "duovox"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, name), tmp_path / name], check=True)
    if (tmp_path / "duovox/llm").exists():
        (tmp_path / "duovox/llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'locked_counts' in q and not any(n.startswith('op') for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
