import os
import subprocess
import sys
import textwrap

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_workers_import_the_package_from_anywhere(tmp_path):
    """A driver that only put the repository on its own path, run from another folder."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
        import sys
        sys.path.insert(0, {repo!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        import __spark_entry__ as e
        print("ROWS", e.queries()["p2_found"](spark, {SF!r}).count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
