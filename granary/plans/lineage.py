"""Intermediate tables and checkpoints in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session, as in tests, gets a temporary one;
    on a cluster it is an error, as executors would not see each other's files."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="granary-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Compressed tables below the shared folder; far smaller than checkpoints of narrow rows, and removable.

    Tables that drop() hasn't removed go when the driver's process ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.place = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def remove(name: str = "") -> None:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}" if name else self.place)
            path.getFileSystem(conf).delete(path, True)

        self._remove = remove
        atexit.register(_at_exit, remove)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """df by way of the table `name`; a later call may write the name again once it is dropped."""
        df.write.option("compression", "zstd").parquet(f"{self.place}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.place}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        for name in names:
            self._remove(name)


def _at_exit(remove) -> None:
    try:
        remove()
    except Exception:  # noqa: BLE001  the JVM may be gone by now
        return
