import subprocess
import sys


import pytest

from coffer.llm import common


def test_a_cluster_without_a_checkpoint_folder_is_refused():
    class Nothing:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://head:7077"
        getConf = staticmethod(Nothing)

    class Session:
        conf, sparkContext = Nothing(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_a_local_session_without_a_checkpoint_folder_gets_one():
    code = """
import sys; sys.path.insert(0, '.')
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
from coffer.llm.common import drop_table, materialize, shared_dir
df = materialize(spark.range(5), 'x')
assert shared_dir(spark) == shared_dir(spark) and df.count() == 5
drop_table(df)
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=180, cwd=__file__.rpartition("/tests/")[0])
