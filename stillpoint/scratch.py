"""Tables that cut lineage: Parquet in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; on one machine (tests) a temporary one, set in the session, where it names none.

    On a cluster without the setting this is an error: each executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="stillpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one run. They live until drop() or the end of the driver: results that read them are lazy."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/stillpoint/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write a table and return it read back: a lost executor costs a task's rows, not what came before."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame | None = None) -> None:
        """Remove one table, or all of them."""
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path if df is not None else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  at exit the JVM may be gone; the folder is the cluster's scratch space
            if df is not None:
                raise
