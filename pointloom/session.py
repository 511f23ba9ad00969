"""Session helpers: table access and scratch storage that every executor can reach."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Where the setting is absent in a local run (as in unit tests) a temporary folder of
    the single machine is set and used; on a cluster that would be each executor's own, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pointloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
        atexit.register(_remove, spark, root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone by then; nothing is left to clean for it
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver exits."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    _remove(spark, path)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def frame_keyed(df: DataFrame, key: str = "frame_index", dealt: bool = False) -> DataFrame:
    """``df`` dealt by frame once, into a bucketed table in the shared folder.

    Whatever is grouped, windowed or joined by the frame, and by the frame and something else, then reads
    its buckets and needs no further shuffle. ``dealt``: the plan of ``df`` ends dealt by frame already.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name, n = f"pointloom_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if dealt else df.repartition(n, key)
    rows.write.bucketBy(n, key).format("parquet").option("path", scratch_path(spark, "by-frame")).saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"drop table if exists {name}")
    except Exception:  # the JVM may be gone by then, and the catalog with it
        pass
