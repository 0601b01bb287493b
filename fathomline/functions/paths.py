"""What a corpus path says about its file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Top folders of the bucket layout, prefixes of the flat layout, and the suffixes that are read.
BUCKETS = ("course", "book", "video", "data")
PREFIXES = (("Video_", "video"), ("Book_", "book"), ("Data_", "data"))
SUFFIXES = ("md", "txt", "vtt", "srt")


def is_source_file(rel: Column) -> Column:
    name = F.element_at(F.split(rel, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)).isin(*SUFFIXES) & ~name.startswith("_")


def classify(rel: Column) -> Column:
    """``struct<kind, course, series>`` of a relative path; null for one that lies too high."""
    parts = F.split(rel, "/")
    top, depth = F.get(parts, F.lit(0)), F.size(parts)
    plain = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    between = F.when(depth > 3, plain(F.array_join(F.slice(parts, F.lit(2), F.greatest(depth - 3, F.lit(0))), "/")))
    # The folder that holds the file names the course, those above it up to the bucket the series.
    bucket = F.when(depth >= 3, F.struct(F.lower(top).alias("kind"), plain(F.get(parts, depth - 2)).alias("course"), between.alias("series")))
    kind, course = F.lit("course"), top
    for prefix, name in reversed(PREFIXES):
        kind = F.when(top.startswith(prefix), F.lit(name)).otherwise(kind)
        course = F.when(top.startswith(prefix), F.substring(top, len(prefix) + 1, 1_000_000)).otherwise(course)
    flat = F.when(depth >= 2, F.struct(kind.alias("kind"), plain(course).alias("course"), F.lit(None).cast("string").alias("series")))
    return F.when(F.lower(top).isin(*BUCKETS), bucket).otherwise(flat)


def chunk_id(rel: Column, ordinal: Column) -> Column:
    """Depends on the path and the chunk's number in its file, not on the text."""
    return F.substring(F.md5(F.concat(rel, F.lit("|"), ordinal.cast("string"))), 1, 12)


def stem(rel: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(rel, "/"), -1), r"(?<=.)\.[^.]*$", "")
