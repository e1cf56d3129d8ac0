"""Intermediate tables in the folder that driver and executors share.

The folder is the one the session names in spark.checkpoint.dir. Where that is unset, a
temporary folder serves a local master, as in tests on one machine; on a cluster it is an
error, since each executor would write to a disk of its own. Tables are Parquet, so a
lost executor costs a reread and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else one local folder for this process if it is all there is."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="palisade-"))
    return f"file://{_local[0]}"


class Workspace:
    """One run's folder; `save` cuts the lineage, `release` deletes the folder."""

    def __init__(self, spark: SparkSession, name: str, parent: str | None = None):
        self.spark = spark
        self.root = f"{parent or shared_folder(spark).rstrip('/') + '/palisade'}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.release)

    def inner(self, name: str) -> Workspace:
        """A folder in this one, to be released before it."""
        return Workspace(self.spark, name, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
        path = path or self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def delete(spark: SparkSession, path: str) -> None:
        """Deletes a folder that no frame reads from any more."""
        with contextlib.suppress(Exception):  # the session may have ended already
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    def release(self) -> None:
        """Deletes the folder; frames that still read from it must have been written before."""
        self.delete(self.spark, self.root)
        atexit.unregister(self.release)
