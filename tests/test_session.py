"""Lineage cuts and the folder they are written to."""

import os
import time
import types

import pytest
from pyspark.sql import functions as F

from cladeworks import session


def asked(master, folder=None, checkpoint=None):
    context = types.SimpleNamespace(master=master, applicationId=f"test-{master}", getCheckpointDir=lambda: checkpoint)
    return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d=None: folder))


def test_shared_folder():
    assert session.shared_folder(asked("spark://a", "file:///x")) == "file:///x"
    assert session.shared_folder(asked("yarn", None, "hdfs://b/c")) == "hdfs://b/c"
    assert session.shared_folder(asked("local[4]")) == session.shared_folder(asked("local[4]")) and session.shared_folder(asked("local"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://a"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(asked(master))


def test_cut_keeps_rows_and_types(spark):
    df = spark.sql("select cast(null as int) a, array(1, null) b, struct('x' as c) d, timestamp_ntz'2024-01-01' t union all select 2, null, null, null")
    got = session.cut(df)
    assert got.schema.simpleString() == df.schema.simpleString() and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert session.cut(df.limit(0)).count() == 0


def test_cut_frees_its_shuffles_and_release_its_files(spark):
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    written = lambda: {f for f in map(str, local.getAllFiles().mkString("|").split("|")) if "shuffle" in f}
    before, setting = written(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    counted = session.cut(spark.range(20_000).groupBy((F.col("id") % 777).alias("k")).agg(F.count(F.lit(1)).alias("n")).repartition(4, "n"))
    until = time.time() + 20
    while written() - before and time.time() < until:
        time.sleep(0.1)
    assert not written() - before and counted.count() == 777
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    (path,) = {os.path.dirname(f.removeprefix("file:")) for f in counted.inputFiles()}
    session.release(counted)
    assert not os.path.exists(path)
