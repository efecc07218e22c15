"""Shared folders: gone when the application ends, refused on a cluster that names none."""

import os
import subprocess
import sys

import pytest

from gridloom.llm import common

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
APP = """
import sys
from gridloom.llm import common
from gridloom.session import session
spark = session("local[1]", 1, spark__ui__enabled="false", spark__checkpoint__dir=sys.argv[1], spark__local__dir=sys.argv[2], spark__sql__warehouse__dir=sys.argv[3])
df = common.stored(spark.range(5), "some")
print("rows", df.count(), df.inputFiles()[0])
spark.stop()
"""


def test_stored_tables_go_with_the_application(tmp_path):
    shared = tmp_path / "shared"
    out = subprocess.run([sys.executable, "-c", APP, str(shared), str(tmp_path / "l"), str(tmp_path / "w")], capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ROOT}, timeout=300)
    assert "rows 5" in out.stdout and str(shared) in out.stdout
    assert not [p for p in shared.iterdir() if p.name.startswith("gridloom")]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="shared folder"):
        common.ensure_checkpoint_dir(Session())


def test_documents_go_over_all_cores(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    assert docs.columns == ["doc_id", "text"] and docs.count() == 1000
    assert docs.selectExpr("spark_partition_id() as p").distinct().count() >= 4
