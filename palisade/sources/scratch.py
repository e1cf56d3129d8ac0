"""Tables that cut a lineage, in the folder that the session names in spark.checkpoint.dir.

Where that is unset, one temporary folder serves a process that is all of Spark, and goes
with it; on a cluster it is an error, as each executor would write to a disk of its own.
A table is Parquet, so that a lost executor costs a second read of it, not of its lineage.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="palisade-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


class Scratch:
    """The tables of one call; those that a result still reads from are deleted when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/palisade/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes the tables, or all of them."""
        for path in [f"{self.root}/{name}" for name in names] or [self.root]:
            with contextlib.suppress(Exception):  # the session may have ended
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
