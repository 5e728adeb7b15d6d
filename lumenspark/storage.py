"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where that is unset and all tasks run in the driver's process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stage:
    """Tables of one run; ``clear`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.folder, self.tables = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """``df`` written once and read back: later jobs compute nothing again, and lost executors lose nothing of it."""
        self.tables += 1
        path = f"{self.folder}/{self.tables:03d}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        held = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        held.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(held, True)
