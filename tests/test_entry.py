import os
import pathlib
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = (
        "import __spark_entry__ as e; q = e.queries()\n"
        "assert 'rank_frames' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)
    # a folder with nothing but compiled files, as deleting the sources leaves it
    (tmp_path / "tessera/llm/__pycache__").mkdir(parents=True)
    (tmp_path / "tessera/llm/__pycache__/registry.cpython-313.pyc").write_bytes(b"x")
    (tmp_path / "corpus_pipeline.py").write_text("ORACLE_SQL = None\nrun = None")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)
    # a fault inside the operators is not taken for their absence
    (tmp_path / "tessera/llm/registry.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True).returncode
