"""Intermediate results that outlive an executor: checkpoints and tables in the shared folder.

The folder is the one that ``spark.checkpoint.dir`` names. Only where it is unset, as in tests, one
under the warehouse is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder, set first where nothing has set it yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the checkpoint by all that follows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any file system that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Parquet tables in a folder of their own, which goes when the block ends.

    What a block returns must not read its tables any more: checkpoint it first.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove_folder(self.spark, self.folder)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as a table and read again."""
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")
