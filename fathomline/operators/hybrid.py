"""Weighted reciprocal-rank fusion of the lexical and the vector ranking, and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.schema import SearchConfig

from .index import Index
from .lexical import lexical_scores, rank, search_lexical


def fuse(lexical: DataFrame, vector: DataFrame, config: SearchConfig) -> DataFrame:
    """``qid, id, rank, rrf, cos`` from ``lexical(qid, id, rank, coverage)`` and ``vector(qid, id, rank, cos)``.

    Lexical hits under the least coverage go before they are ranked, vector hits
    under the least cosine after, so that their ranks keep gaps. A chunk without
    a vector hit has cosine 0.
    """
    lex = lexical.where(F.round("coverage", 2) >= config.lex_min_cov).withColumn("place", F.row_number().over(_by("qid", "rank")) - 1)
    lex = lex.select("qid", "id", (config.w_lex / (config.rrf_k + F.col("place"))).alias("part"), F.col("place").alias("lex"), F.lit(None).cast("int").alias("vec"), F.lit(None).cast("double").alias("cos"))
    vec = vector.where(F.col("cos") >= config.vec_min_cos)
    vec = vec.select("qid", "id", (config.w_vec / (config.rrf_k + F.col("rank"))).alias("part"), F.lit(None).cast("int").alias("lex"), F.col("rank").alias("vec"), "cos")
    both = lex.union(vec).groupBy("qid", "id").agg(F.sum("part").alias("rrf"), F.min("lex").alias("lex"), F.min("vec").alias("vec"), F.coalesce(F.max("cos"), F.lit(0.0)).alias("cos"))
    ranked = both.withColumn("rank", rank("rrf", F.asc_nulls_last("lex"), F.asc_nulls_last("vec")))
    return ranked.where(F.col("rank") < config.take).select("qid", "id", "rank", "rrf", "cos")


def _by(part: str, *order: str):
    return Window.partitionBy(part).orderBy(*order)


def search_hybrid(index: Index, queries: DataFrame, vector: DataFrame, config: SearchConfig | None = None, course: str | None = None, kind: str | None = None) -> DataFrame:
    """``qid, id, rank, rrf, cos, coverage, tfidf``, written; ``vector`` is the vector ranking, already filtered like the chunks.

    Both scores are those over the whole corpus, 0 for a hit that holds no term of its query.
    """
    config = config or SearchConfig()
    lexical = search_lexical(index, queries, config, course, kind, config.recall_pool)
    fused = index.tables.write(fuse(lexical, vector.where(F.col("rank") < config.recall_pool), config), "fused")
    scored = lexical_scores(index, queries, config, only=fused).select("qid", "id", "coverage", "tfidf")
    return index.tables.write(fused.join(scored, ["qid", "id"], "left").na.fill(0.0, ["coverage", "tfidf"]), "hits")


#: Scores ``qid, id, q, text`` rows with a column ``rerank``; a model goes here as a vectorised function.
Scorer = Callable[[DataFrame], DataFrame]


def rerank(hits: DataFrame, queries: DataFrame, index: Index, k: int, scorer: Scorer | None = None) -> DataFrame:
    """The hits' best ``k`` by the scorer, which only ever sees the recalled pool: ``qid, id, rank, rerank``.

    Without a scorer the TF-IDF cosine decides.
    """
    if scorer is None:
        scored = hits.withColumn("rerank", F.col("tfidf"))
    else:
        scored = scorer(hits.select("qid", "id").join(queries, "qid").join(index.chunks.select("id", "text"), "id"))
    placed = scored.select("qid", "id", "rerank").join(hits.select("qid", "id", F.col("rank").alias("before")), ["qid", "id"])
    return placed.withColumn("rank", rank("rerank", F.asc("before"))).where(F.col("rank") < k).select("qid", "id", "rank", "rerank")


def diagnostics(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Scores of hits with where they come from, for display."""
    shown: list[Column] = [F.col("qid"), F.col("rank"), F.col("rrf"), F.col("cos"), F.col("coverage"), F.col("kind"), F.col("course"), F.col("section")]
    return hits.join(chunks.select("id", "kind", "course", "section"), "id").select(*shown)
