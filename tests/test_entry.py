"""The driver contract: names match, SQL names its queries, the flagship query runs, and the library stands without llm."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100
    df = e.entry(spark)
    assert df.columns == ["case_id", "label", "volume_ml", "dice", "slo"] and df.count() == 30


def test_without_llm(tmp_path):
    """A copy without the subpackage and the pipeline still imports, with the other queries, and other tests pass there."""
    import shutil

    shutil.copytree(f"{ROOT}/cohortmill", tmp_path / "cohortmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and len(q) > 90"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    shutil.copytree(f"{ROOT}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    some = ["tests/test_reference.py", "-q", "-x", "-k", "validation or leaky or surrogates", "-p", "no:cacheprovider"]
    subprocess.run([sys.executable, "-m", "pytest", *some], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=900)
