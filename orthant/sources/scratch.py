"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders of this process that were not removed yet.
_open: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; a folder of its own only where that is unset, in local mode."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="orthant-"))
    return sc.getCheckpointDir().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_open.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may already be gone at exit
            pass


class Scratch:
    """Intermediate Parquet tables of one run, below the shared folder.

    Writing a table cuts the lineage, so a lost executor costs one step at
    most. Tables that a returned DataFrame still reads stay until the process
    ends; the others are dropped as soon as the next step is written.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        _open[self.root] = spark

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put(self, content: bytes, name: str) -> str:
        """Write a small file into the folder; returns its path."""
        path = f"{self.root}/{name}"
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(p)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        return path

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")
