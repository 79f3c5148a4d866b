"""Queries on executors that are processes of their own, as on a cluster."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from oracle import compare, connect

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
RUN = """
import sys
from pyspark.sql import SparkSession
from millrace import queries
name, sf_dir, shared = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.driver.memory": "700m", "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{shared}"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
queries.queries()[name](spark, sf_dir).coalesce(1).write.parquet(f"file://{shared}/out")
spark.stop()
"""


def on_cluster(name, tmp_path):
    home = tmp_path / "home"  # executors write their logs to work in Spark's home
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    ran = subprocess.run([sys.executable, "-c", RUN, name, SF, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-3000:]
    return str(tmp_path / "shared" / "out")


@pytest.mark.parametrize("name", ["jdbc_range_union", "table_range_union"])
def test_every_executor_reads_the_database(spark, tmp_path, name):
    from millrace import queries

    compare(spark.read.parquet(on_cluster(name, tmp_path)), connect(SF), queries.oracle_sql()[name])


def test_a_database_holds_awkward_values(spark):
    from millrace import queries

    rows = [(1, None), (2, ""), (3, " a "), (None, 'x"y'), (5, "a,b"), (6, "l\nm"), (7, '"'), (8, "\\"), (9, "é中😀"), (10, "NULL"), (11, '\\"'), (12, "'"), (13, "\r\n"), (None, None)]
    df = spark.createDataFrame(rows, "K long, S string").repartition(3)
    url = queries._database(spark, {"T": ("K BIGINT, S VARCHAR(8)", df), "NONE_AT_ALL": ("K BIGINT, S VARCHAR(8)", df.where("false"))})
    read = lambda name: spark.read.format("jdbc").options(url=url, dbtable=name).load()
    assert sorted(map(tuple, read("T").collect()), key=repr) == sorted(rows, key=repr)
    assert read("NONE_AT_ALL").count() == 0
