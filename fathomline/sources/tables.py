"""Tables that an engine writes for itself, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


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


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


class Tables:
    """Tables under one new folder; ``write`` writes one and reads it back, so that a lost executor costs no more than a task."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self._next = spark, f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, name: str = "table") -> DataFrame:
        return self.write_all([df], name)

    def write_all(self, parts: Iterable[DataFrame], name: str = "table") -> DataFrame:
        """One table of DataFrames with the same columns, written one after another."""
        path = f"{self.root}/{self._next}-{name}"
        self._next += 1
        for df in parts:
            df.write.option("compression", "zstd").mode("append").parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read._table_path = path
        return read

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, fs = _path(self.spark, table._table_path)
            fs.delete(path, True)

    def there(self) -> bool:
        path, fs = _path(self.spark, self.root)
        return fs.exists(path)


#: The column by which ``in_blocks`` joins: set by ``monotonically_increasing_id`` when the table is written.
PLACE = "place"
#: The most rows that it broadcasts at once.
PLACE_BLOCK = 1 << 19


def in_blocks(rows: DataFrame, found: DataFrame, block: int = PLACE_BLOCK) -> Iterator[DataFrame]:
    """Written ``rows`` joined with what was found for them, both by PLACE: blocks of them, one after another.

    ``found`` has a narrow row for each place that is wanted. It is broadcast for ``block``
    rows at once, so that wide rows stay in the files that they were written to.
    """
    # How many places each file has: one row for each.
    last = F.max(F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted(found.groupBy(F.shiftright(PLACE, 33).alias("part")).agg((last + 1).alias("n")).collect())
    starts, held = [0], 0
    for part, n in sizes:
        at = 0
        while held + n - at > block:
            at += block - held
            starts.append((part << 33) + at)
            held = 0
        held += n - at
    for a, z in zip(starts, [*starts[1:], None]):
        here = (F.col(PLACE) >= a) & (F.lit(True) if z is None else F.col(PLACE) < z)
        yield rows.where(here).join(F.broadcast(found.where(here)), PLACE)  # block rows


def version(table: DataFrame) -> tuple:
    """What changes when the files of a table do: their number, and a hash of their paths, sizes and times."""
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(files.agg(F.count("*"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first())
