"""An inverted index that grows by segments: an update tokenises new and deleted chunks alone.

A segment holds the chunks it adds with their terms, the ids it hides, and signed
document frequencies and lengths. These add up over segments, so corpus
statistics come from the vocabulary, never from texts. Segments of a level are
merged, ``fanout`` at a time, into one of the next; every posting is rewritten
a logarithmic number of times. What searches read is made when a snapshot is
taken, since norms depend on all frequencies.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.sources.tables import PLACE, PLACE_BLOCK, Tables, in_blocks
from fathomline.sources.versions import Part, Version, Versions

from .index import Index, count_terms, idf_stats, norms, term_freq, words
from .sections import numbered

_ABOUT = "`order` struct<path: array<string>, ordinal: int>, course string, kind string"
_CHUNKS = f"id string, rel string, ordinal int, {_ABOUT}, layer string, series string, section string, text string, print string, seq bigint"
_TERMS = f"id string, {_ABOUT}, dl bigint, toks array<string>, tfs array<int>, seq bigint"
_FREQ, _SIZES = "tok string, df bigint", "n bigint, total bigint"
_IDF, _STATS = "tok string, df bigint, idf_bm25 double, idf_tfidf double", "n bigint, avgdl double"


def fingerprint():
    """A hash of everything of a chunk that search or display reads, nulls told apart from empty texts."""
    return F.md5(F.to_json(F.struct("course", "kind", "layer", "series", "section", "text"), {"ignoreNullFields": "false"}))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id, change`` between two states ``id, print`` of a corpus: added, changed or removed; equal chunks are left out.

    Ids are unique in each state. Only ids and hashes are shuffled.
    """
    old, new = before.select("id", F.col("print").alias("was")), after.select("id", F.col("print").alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return old.join(new, "id", "full_outer").select("id", change.alias("change")).where("change is not null")


def _sent(ids: DataFrame) -> DataFrame:
    """Written ids, broadcast if they are PLACE_BLOCK at most, so that the rows that they are looked up in stay where they are."""
    return F.broadcast(ids) if ids.count() <= PLACE_BLOCK else ids


class LiveIndex:
    """The index of a corpus that changes.

    ``sync(chunks)`` brings it to a new state of all chunks ``rel, ordinal, id,
    course, kind, layer, series, section, text``; ``update(added, removed)``
    applies a known change. ``snapshot()`` is what searches take. Ties go by
    path and ordinal, which is the corpus-wide order without numbering anew.
    Null texts have no tokens; an empty corpus has an empty index; ids are
    unique within a state.
    """

    def __init__(self, spark: SparkSession, root: str, fanout: int = 4):
        self.spark, self.versions, self.fanout = spark, Versions(spark, root), fanout

    def chunks(self, version: Version | None = None) -> DataFrame:
        version = version or self.versions.latest()
        return self.versions.alive(version, self.versions.read(version, "chunks", _CHUNKS))

    def sync(self, chunks: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Applies the difference to the present state and returns it: ``id, change``."""
        version, tables = self.versions.latest(), Tables(self.spark, "changes")
        found = tables.write(changes(self.chunks(version), chunks.select("id", fingerprint().alias("print"))))
        added = chunks.join(_sent(found.where("change <> 'removed'").select("id")), "id", "left_semi")
        self.update(added, found.where("change <> 'added'").select("id"), batch)
        return found

    def update(self, added: DataFrame, removed: DataFrame | None = None, batch: tuple[str, int] | None = None) -> Version:
        """Adds chunks and hides the removed ids; a chunk that changes is in both."""
        version = self.versions.latest()
        if version.has(batch):
            return version
        path, seq = self.versions.new_folder(), version.number + 1
        order = F.struct(F.split("rel", "/").alias("path"), F.col("ordinal").cast("int").alias("ordinal"))
        rows = added.withColumn("order", order).withColumn("print", fingerprint()).withColumn("seq", F.lit(seq).cast("long"))
        fresh = self._write(rows, path, "chunks", _CHUNKS)
        terms = self._write(count_terms(fresh.select("id", "order", "course", "kind", "seq", words().alias("words"))), path, "terms", _TERMS)
        plus = term_freq(terms)
        sizes = terms.select(F.lit(1).alias("n"), "dl")
        if removed is not None:
            deletes = self._write(removed.select("id").distinct().withColumn("seq", F.lit(seq).cast("long")), path, "deletes", "id string, seq bigint")
            gone = self.versions.alive(version, self.versions.read(version, "terms", _TERMS).join(_sent(deletes.select("id")), "id", "left_semi"))
            minus = term_freq(gone).select("tok", -F.col("df"))
            plus = plus.union(minus).groupBy("tok").agg(F.sum("df").alias("df"))
            sizes = sizes.union(gone.select(F.lit(-1), -F.col("dl")))
        self._write(plus.where("df <> 0"), path, "freq", _FREQ)
        self._write(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")), path, "sizes", _SIZES)
        parts = (*version.parts, Part(path, seq, deletes=removed is not None))
        published = self.versions.publish(version.following(parts, batch, self._statistics(Version(seq, parts), path)))
        run = self.versions.to_merge(published, self.fanout)
        return self._merge(published, run) if run else published

    def snapshot(self, version: Version | None = None) -> Index:
        """The index of a version. Hidden rows, places in the corpus-wide order and norms are found by narrow rows; the terms' rows are written anew, never shuffled."""
        version = version or self.versions.latest()
        if not version.parts:
            raise ValueError(f"{self.versions.root} holds no version yet")
        read = lambda name, ddl: self.spark.read.schema(ddl).parquet(version.tables[name])
        tables, idf = Tables(self.spark, "live"), read("idf", _IDF)
        counted = tables.write(self.versions.read(version, "terms", _TERMS).withColumn(PLACE, F.monotonically_increasing_id()), "counts")
        keys = self.versions.alive(version, counted.select("id", "seq", "order", F.col(PLACE).alias("at"))).select("order.path", "order.ordinal", "at")
        keys = keys.repartitionByRange("path", "ordinal").sortWithinPartitions("path", "ordinal").select("at").withColumn("place", F.monotonically_increasing_id())
        places = numbered(tables.write(keys, "order")).withColumnRenamed("at", PLACE)
        found = tables.write(places.join(norms(counted, idf, tables), PLACE), "places")
        terms = tables.write_all(in_blocks(counted.drop("order", "seq"), found), "terms").drop(PLACE)
        tables.drop(counted)
        return Index(tables, self.chunks(version), terms, read("stats", _STATS), idf)

    def _statistics(self, version: Version, path: str) -> dict[str, str]:
        """The version's statistics from the segments' sums."""
        read = lambda name, ddl: self.versions.read(version, name, ddl)
        total = read("sizes", _SIZES).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        stats = self._write(total.select("n", F.coalesce(F.try_divide("total", "n"), F.lit(0.0)).alias("avgdl")), path, "stats", _STATS)
        freq = read("freq", _FREQ).groupBy("tok").agg(F.sum("df").alias("df")).where("df > 0")
        self._write(idf_stats(freq, stats), path, "idf", _IDF)
        return {name: f"{path}/{name}" for name in ("stats", "idf")}

    def _merge(self, version: Version, run: tuple[Part, ...]) -> Version:
        path, own = self.versions.new_folder(), replace(version, parts=run)
        part, deletes = self.versions.merged_part(version, run, path)
        for name, ddl in (("chunks", _CHUNKS), ("terms", _TERMS)):
            rows = self.versions.alive(own, self.versions.read(own, name, ddl)).withColumn("seq", F.lit(part.seq).cast("long"))
            self._write(rows, path, name, ddl)
        self._write(self.versions.read(own, "freq", _FREQ).groupBy("tok").agg(F.sum("df").alias("df")).where("df <> 0"), path, "freq", _FREQ)
        self._write(self.versions.read(own, "sizes", _SIZES).agg(F.sum("n").alias("n"), F.sum("total").alias("total")), path, "sizes", _SIZES)
        if deletes is not None:
            self._write(deletes, path, "deletes", "id string, seq bigint")
        return self.versions.publish(version.following((*[p for p in version.parts if p not in run], part)))

    def _write(self, rows: DataFrame, path: str, name: str, ddl: str) -> DataFrame:
        names = self.spark.createDataFrame([], ddl).columns
        rows.select(*[F.col(f"`{c}`") for c in names]).write.option("compression", "zstd").parquet(f"{path}/{name}")
        return self.spark.read.schema(ddl).parquet(f"{path}/{name}")
