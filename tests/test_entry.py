"""The driver's contract: the entry has rows, and all but the llm folders stands by itself."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_all_but_the_llm_folders_stands_by_itself(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    # one that can't be imported without the folders
    (tmp_path / "corpus_pipeline.py").write_text("import skygraph.llm.common\n")
    shutil.copytree(f"{ROOT}/skygraph", tmp_path / "skygraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    listed = "import __spark_entry__ as e, bench; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') or n == 'pipeline' for n in q))"
    for gone in ("", "corpus_pipeline.py"):
        if gone:
            os.remove(tmp_path / gone)
        found = subprocess.run([sys.executable, "-c", listed], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
        n, m, llm = found.stdout.split()
        assert int(n) >= int(m) > 50 and llm == "False", found.stderr
