"""Stores of immutable parts under versioned manifests.

A change writes new parts and then one manifest file, by a rename that never
replaces another: readers see a whole version or the one before, and of two
writers at once one fails. Rows carry the version that wrote them (``seq``);
a deletion is a row ``id, seq`` that hides all rows of the id with a smaller
``seq``, so no part is ever rewritten but by merging. A numbered batch that is
replayed changes nothing. Renames are atomic on local disks and HDFS; on an
object store the folder needs a committer that makes them so.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.vectors import normalize

from .tables import _path


class Conflict(RuntimeError):
    """Another writer has published the version first."""


@dataclass(frozen=True)
class Part:
    """A folder of tables; ``seq`` is its newest row's, ``level`` the number of merges behind it."""

    path: str
    seq: int
    level: int = 0
    deletes: bool = False


@dataclass(frozen=True)
class Version:
    number: int = 0
    parts: tuple[Part, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)
    tables: dict[str, str] = field(default_factory=dict)

    def has(self, batch: tuple[str, int] | None) -> bool:
        """Whether the batch ``(source, number)`` is in; a source's numbers grow."""
        return batch is not None and self.batches.get(batch[0], -1) >= batch[1]

    def following(self, parts: tuple[Part, ...], batch: tuple[str, int] | None = None, tables: dict[str, str] | None = None) -> Version:
        batches = self.batches if batch is None else self.batches | {batch[0]: batch[1]}
        return Version(self.number + 1, parts, batches, self.tables if tables is None else tables)


class Versions:
    """The manifests and tables of one store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def numbers(self) -> list[int]:
        path, fs = _path(self.spark, f"{self.root}/versions")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def latest(self) -> Version:
        numbers = self.numbers()
        return self.at(numbers[-1]) if numbers else Version()

    def at(self, number: int) -> Version:
        path, fs = _path(self.spark, self._manifest(number))
        stream = fs.open(path)
        try:
            told = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(told["number"], tuple(Part(**p) for p in told["parts"]), told["batches"], told["tables"])

    def publish(self, version: Version) -> Version:
        """Makes the version the latest one; Conflict if its number is taken."""
        jvm = self.spark._jvm
        target, fs = _path(self.spark, self._manifest(version.number))
        draft, _ = _path(self.spark, f"{self.root}/versions/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(asdict(version)).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(draft, target, options)
        except Exception as error:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(error):
                raise Conflict(f"version {version.number} of {self.root} is already there") from error
            raise
        return version

    def new_folder(self) -> str:
        return f"{self.root}/parts/{uuid.uuid4().hex}"

    def read(self, version: Version, name: str, ddl: str, divided: bool = False) -> DataFrame:
        """A table's rows in all parts, hidden ones too; ``divided`` tables have folders for the values of a column."""
        paths = [f"{p.path}/{name}" for p in version.parts]
        if divided and paths:
            return reduce(DataFrame.unionByName, [self.spark.read.schema(ddl).parquet(p) for p in paths])
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def alive(self, version: Version, rows: DataFrame) -> DataFrame:
        """Rows ``id, seq, ...`` without those that a later deletion hides."""
        paths = [f"{p.path}/deletes" for p in version.parts if p.deletes]
        if not paths:
            return rows
        gone = self.spark.read.schema("id string, seq bigint").parquet(*paths).groupBy("id").agg(F.max("seq").alias("gone"))
        return rows.join(gone.withColumnRenamed("id", "gone_id"), (F.col("id") == F.col("gone_id")) & (F.col("gone") > F.col("seq")), "left_anti")

    def to_merge(self, version: Version, fanout: int) -> tuple[Part, ...]:
        """The newest parts of one level, if they are ``fanout`` or more; merged they make one of the next level."""
        parts = sorted(version.parts, key=lambda p: p.seq)
        level = parts[-1].level if parts else 0
        run: list[Part] = []
        while parts and parts[-1].level == level:
            run.insert(0, parts.pop())
        return tuple(run) if len(run) >= fanout else ()

    def merged_part(self, version: Version, run: tuple[Part, ...], path: str) -> tuple[Part, DataFrame | None]:
        """The part that replaces a run, and the deletions it must keep: none if nothing older is left."""
        oldest = min(p.seq for p in version.parts) == run[0].seq
        kept = [f"{p.path}/deletes" for p in run if p.deletes and not oldest]
        deletes = self.spark.read.schema("id string, seq bigint").parquet(*kept).groupBy("id").agg(F.max("seq").alias("seq")) if kept else None
        return Part(path, run[-1].seq, run[0].level + 1, bool(kept)), deletes

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the newest ``keep`` versions, and the folders that only those used. No writer may be at work."""
        numbers = self.numbers()
        held = [self.at(n) for n in numbers[-keep:]]
        used = {p.path for v in held for p in v.parts} | {t.rsplit("/", 1)[0] for v in held for t in v.tables.values()}
        for number in numbers[:-keep]:
            path, fs = _path(self.spark, self._manifest(number))
            fs.delete(path, False)
        parts, fs = _path(self.spark, f"{self.root}/parts")
        if not fs.exists(parts):
            return
        names = {u.rsplit("/", 1)[1] for u in used}
        for status in fs.listStatus(parts):
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)

    def _manifest(self, number: int) -> str:
        return f"{self.root}/versions/{number:010d}.json"


class VectorStore:
    """Vectors ``id, vec`` at unit length in versions; parts are divided into ``buckets`` of ids.

    ``upsert`` leaves ids that the store holds as they are; of an id that comes
    several times the smallest ``pos`` counts, or any if there is none. Null
    ids and null vectors are not stored.
    """

    SCHEMA = "id string, vec array<float>, seq bigint, bucket int"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, fanout: int = 8):
        self.versions, self.buckets, self.fanout = Versions(spark, root), buckets, fanout

    def read(self, version: Version | None = None) -> DataFrame:
        version = version or self.versions.latest()
        return self.versions.alive(version, self.versions.read(version, "vectors", self.SCHEMA, divided=True)).select("id", "vec", "bucket")

    def upsert(self, added: DataFrame, batch: tuple[str, int] | None = None) -> Version:
        version = self.versions.latest()
        if version.has(batch):
            return version
        rows = added.where("id is not null and vec is not null").withColumn("bucket", self._bucket())
        pos = F.col("pos") if "pos" in added.columns else F.lit(0)
        first = rows.groupBy("bucket", "id").agg(F.min_by("vec", pos).alias("vec"))
        # Semi-join first: buckets that no added id falls into are not read.
        held = self.read(version).select("bucket", "id").join(rows.select("bucket", "id"), ["bucket", "id"], "left_semi")
        fresh = first.join(held, ["bucket", "id"], "left_anti").select("id", normalize(F.col("vec")).cast("array<float>").alias("vec"), F.lit(version.number + 1).cast("long").alias("seq"), "bucket")
        path = self.versions.new_folder()
        self._write(fresh, path)
        return self._publish(version, Part(path, version.number + 1), batch)

    def remove(self, ids: DataFrame, batch: tuple[str, int] | None = None) -> Version:
        """Takes ids out, so that the next upsert may set them anew."""
        version = self.versions.latest()
        if version.has(batch):
            return version
        path, seq = self.versions.new_folder(), version.number + 1
        self._write(self.versions.spark.createDataFrame([], self.SCHEMA), path)
        ids.select("id").distinct().withColumn("seq", F.lit(seq).cast("long")).write.parquet(f"{path}/deletes")
        return self._publish(version, Part(path, seq, deletes=True), batch)

    def _bucket(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/vectors")

    def _publish(self, version: Version, part: Part, batch: tuple[str, int] | None) -> Version:
        published = self.versions.publish(version.following((*version.parts, part), batch))
        run = self.versions.to_merge(published, self.fanout)
        return self._merge(published, run) if run else published

    def _merge(self, version: Version, run: tuple[Part, ...]) -> Version:
        path = self.versions.new_folder()
        part, deletes = self.versions.merged_part(version, run, path)
        own = replace(version, parts=run)
        rows = self.versions.alive(own, self.versions.read(own, "vectors", self.SCHEMA, divided=True)).withColumn("seq", F.lit(part.seq).cast("long"))
        self._write(rows, path)
        if deletes is not None:
            deletes.write.parquet(f"{path}/deletes")
        return self.versions.publish(version.following((*[p for p in version.parts if p not in run], part)))
