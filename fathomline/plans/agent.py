"""The answering loop's data side: batched search rounds, teaching a section, drafting from hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import collapse, contains_folded, tokens
from fathomline.operators.catalog import met
from fathomline.operators.index import Index
from fathomline.operators.lexical import search_lexical
from fathomline.schema import SearchConfig

# Rounds, the coverage that is enough, the largest list, and the coverage that teaching asks for.
MAX_ROUNDS = 3
ENOUGH = 0.55
LARGEST_K = 24
TEACH_LEAST = 0.7


def plan_courses(queries: DataFrame, courses: DataFrame) -> DataFrame:
    """``qid, q, course``: the first course whose name contains a word of the query of three characters or more."""
    words = queries.select("qid", F.explode(F.filter(F.split(F.lower("q"), r"(?U)\s+"), lambda w: F.length(w) > 2)).alias("word"))
    found = met(words, courses.select("course", "place"), F.contains(F.lower("course"), F.col("word")), F.struct("place", "course"))
    first = found.select("qid", F.col("best.course").alias("course"))
    return queries.select("qid", "q").join(first, "qid", "left")


def search_rounds(index: Index, planned: DataFrame, config: SearchConfig | None = None) -> DataFrame:
    """Up to three rounds of search: ``qid, rounds, coverage, n_hits, blocked``.

    A query is done once its top hit covers enough of it or nothing is found.
    The others first drop their course filter, if they have one, and then
    double their list. Only the filter changes a ranking and lists are cut from
    the longest one, so two batched searches serve all rounds of all queries.
    """
    config = config or SearchConfig()
    asked = planned.select("qid", "q")

    def tops(hits: DataFrame, nth: int) -> DataFrame:
        cov = F.max(F.when(F.col("rank") == 0, F.round("coverage", 2)))
        return hits.groupBy("qid").agg(cov.alias(f"cov{nth}"), F.count("*").alias(f"found{nth}"))

    bound = tops(search_lexical(index, asked, config, k=LARGEST_K, scope=planned.select("qid", "course")), 1)
    free = tops(search_lexical(index, asked, config, k=LARGEST_K), 2)
    rows = planned.select("qid", "course").join(bound, "qid", "left").join(free, "qid", "left").na.fill(0)
    over = lambda n: (F.col(f"cov{n}") >= ENOUGH) | (F.col(f"found{n}") == 0)
    filtered = F.col("course").isNotNull()
    rounds = F.when(over(1), 1).when(filtered & over(2), 2).otherwise(MAX_ROUNDS)
    last = F.col("rounds") > 1
    k = F.lit(config.k)
    size = F.when(~last | (filtered & (F.col("rounds") == 2)), k).when(filtered, F.least(k * 2, F.lit(LARGEST_K))).otherwise(F.least(F.least(k * 2, F.lit(LARGEST_K)) * 2, F.lit(LARGEST_K)))
    found = F.when(last, F.col("found2")).otherwise(F.col("found1"))
    return rows.withColumn("rounds", rounds).select(
        "qid", "rounds", F.when(last, F.col("cov2")).otherwise(F.col("cov1")).alias("coverage"), F.least(found, size).cast("long").alias("n_hits"), (found == 0).alias("blocked")
    )


def teach_section(index: Index, queries: DataFrame, course: str, config: SearchConfig | None = None) -> DataFrame:
    """``qid, section, n_chunks, coverage, low``: the section of each query's best hit, or the course's first one, and how much of the query it holds."""
    best = search_lexical(index, queries, config, course=course, k=1).join(index.chunks.select("id", "section"), "id").select("qid", "section")
    own = index.chunks.where(contains_folded(F.col("course"), F.lit(course)))
    opening = own.agg(F.min_by("section", "order").alias("opening"))
    chosen = queries.select("qid", "q").join(best, "qid", "left").crossJoin(F.broadcast(opening)).select("qid", "q", F.coalesce("section", "opening").alias("section")).where("section is not null")  # one row
    texts = own.select("section", "id", F.explode_outer(tokens(F.col("text"))).alias("tok"))
    sizes = own.groupBy("section").agg(F.count("*").alias("n_chunks"))
    asked = chosen.select("qid", "section", F.explode(F.array_distinct(tokens(F.col("q")))).alias("tok"))
    held = texts.select("section", "tok").distinct().withColumn("held", F.lit(1))
    share = asked.join(held, ["section", "tok"], "left").groupBy("qid").agg((F.count("held") / F.count("*")).alias("coverage"))
    return chosen.join(sizes, "section").join(share, "qid", "left").select("qid", "section", "n_chunks", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), (F.coalesce("coverage", F.lit(0.0)) < TEACH_LEAST).alias("low"))


def draft(hits: DataFrame, chunks: DataFrame, most: int = 4, limit: int = 180) -> DataFrame:
    """``qid, answer``: excerpts of the first hits with their sources, the offline stand-in for a language model."""
    rows = hits.where(F.col("rank") < most).join(chunks.select("id", "course", "section", "text"), "id")
    line = F.concat(F.lit("· "), F.substring(collapse(F.col("text")), 1, limit), F.lit("… ⟨"), "course", F.lit("·"), "section", F.lit("⟩"))
    listed = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("ls"))
    return listed.select("qid", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("answer"))
