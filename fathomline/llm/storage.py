"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table there and reading it
back, so a lost executor never costs more than the step it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; tests on a local master may leave it unset."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """Tables written under the shared folder.

    What a result still reads stays; ``keep`` drops all others at the end of an operator.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._next = 0
        self._held: list[DataFrame] = []

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/t{self._next}"
        self._next += 1
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read._scratch_path = path
        self._held.append(read)
        return read

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._held = [t for t in self._held if t is not table]
            self.delete(table._scratch_path)

    def delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *tables: DataFrame) -> None:
        """Drops every table but these."""
        self.drop(*[t for t in self._held if not any(t is k for k in tables)])
