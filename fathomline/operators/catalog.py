"""What a corpus holds: courses, outlines, whole sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import contains_folded

#: The most wishes that are broadcast at once; more are matched block by block.
WISH_BLOCK = 4096


def list_courses(chunks: DataFrame) -> DataFrame:
    """``course, n``, most first, then as first met."""
    return chunks.groupBy("course").agg(F.count("*").alias("n"), F.min("order").alias("first")).orderBy(F.desc("n"), "first").select("course", "n")


def outline(chunks: DataFrame, course: str) -> DataFrame:
    """``section, first``: sections of the matching courses as first met."""
    return chunks.where(contains_folded(F.col("course"), F.lit(course))).groupBy("section").agg(F.min("order").alias("first")).orderBy("first")


def fetch_section(chunks: DataFrame, course: str, section: str) -> DataFrame:
    rows = chunks.where(contains_folded(F.col("course"), F.lit(course)) & (F.col("section") == section))
    return rows.select("id", "course", "section", "order", "text", "layer").orderBy("order")


def ingest_stats(chunks: DataFrame) -> DataFrame:
    """``course, files, chunks`` of each course, and of all under a null course, from rows with ``rel``."""
    return chunks.rollup("course").agg(F.count_distinct("rel").alias("files"), F.count("*").alias("chunks"))


def course_match(queries: DataFrame, courses: DataFrame) -> DataFrame:
    """``qid, course``: of ``courses(course, n, first)`` the one that equals the wish, else the first that contains it."""
    wish, name = F.lower("q"), F.lower("course")
    best = F.struct((name != wish).alias("loose"), (-F.col("n")).alias("less"), "first", "course")
    found = met(queries.select("qid", "q"), courses, F.contains(name, wish), best)
    return queries.select("qid").join(found.select("qid", F.col("best.course").alias("course")), "qid", "left")


def met(wishes: DataFrame, courses: DataFrame, match: Column, best: Column) -> DataFrame:
    """``qid, best``: the least ``best`` over all courses that ``match`` a row of ``wishes(qid, ...)``.

    A substring test has no key to join on. All courses stay where they are, the
    wishes are broadcast in blocks of WISH_BLOCK, and each task keeps only its
    least row of a wish before anything is shuffled.
    """
    blocks = max(1, -(-wishes.count() // WISH_BLOCK))
    found = None
    for at in range(blocks):
        block = F.broadcast(wishes.where(F.pmod(F.xxhash64(*wishes.columns), F.lit(blocks)) == at))  # about WISH_BLOCK rows
        part = courses.join(block, match).groupBy("qid").agg(F.min(best).alias("best"))
        found = part if found is None else found.union(part)
    return found.groupBy("qid").agg(F.min("best").alias("best"))
