"""Whether claims are supported by the chunks they cite. Claims are ``qid, claim, chunk_ids``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions.text import tokens
from fathomline.functions.vectors import dot, normalize
from fathomline.schema import SearchConfig
from fathomline.sources.tables import Tables


def _cited(claims: DataFrame) -> DataFrame:
    """``qid, id``, written, so that Spark knows whether they are few enough to leave the chunks where they are."""
    return Tables(claims.sparkSession, "cited").write(claims.select("qid", F.explode("chunk_ids").alias("id")).distinct())


def verify_lexical(claims: DataFrame, chunks: DataFrame, config: SearchConfig | None = None) -> DataFrame:
    """``qid, supported, coverage, missing``: the share of the claim's distinct tokens that the cited texts hold.

    Unknown ids are ignored; an empty claim is unsupported. ``missing`` has the first twelve in order.
    """
    config = config or SearchConfig()
    own = claims.select("qid", F.explode_outer(F.array_distinct(tokens(F.col("claim")))).alias("tok"))
    pool = _cited(claims).join(chunks.select("id", "text"), "id").select("qid", F.explode(tokens(F.col("text"))).alias("tok")).distinct().withColumn("held", F.lit(True))
    met = own.join(pool, ["qid", "tok"], "left")
    share = F.count("held") / F.nullif(F.count("tok"), F.lit(0))
    return (
        met.groupBy("qid")
        .agg(F.coalesce(share, F.lit(0.0)).alias("coverage"), F.slice(F.sort_array(F.collect_list(F.when(F.col("held").isNull(), F.col("tok")))), 1, 12).alias("missing"))
        .select("qid", (F.col("coverage") >= config.supported_cov).alias("supported"), "coverage", "missing")
    )


def verify_semantic(claims: DataFrame, vectors: DataFrame, claim_vectors: DataFrame) -> DataFrame:
    """``qid, score``: the highest cosine of the claim with a cited chunk; 0 for a blank claim or without known ids."""
    held = vectors.select("id", normalize(F.col("vec")).alias("iv"))
    asked = claim_vectors.select("qid", normalize(F.col("vec")).alias("qv"))
    best = _cited(claims).join(held, "id").join(asked, "qid").groupBy("qid").agg(F.max(dot(F.col("qv"), F.col("iv"))).alias("best"))
    blank = F.length(F.trim(F.coalesce("claim", F.lit("")))) == 0
    return claims.select("qid", "claim").join(best, "qid", "left").select("qid", F.when(blank, 0.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def citations(claims: DataFrame, known: DataFrame) -> DataFrame:
    """``qid, real, fake``: the cited ids that exist in ``known(id)`` and those that don't, sorted."""
    cited = claims.select("qid", F.explode_outer("chunk_ids").alias("id")).distinct()
    flagged = cited.join(known.select("id").distinct().withColumn("is_real", F.lit(True)), "id", "left")
    pick = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("id"))))
    return flagged.groupBy("qid").agg(pick(F.col("is_real")).alias("real"), pick(F.col("is_real").isNull() & F.col("id").isNotNull()).alias("fake"))


def verdicts(cited: DataFrame, scores: DataFrame, floor: float) -> DataFrame:
    """``qid, verdict, score``: BLOCK without a real citation, else by the floor."""
    joined = cited.join(scores.select("qid", "score"), "qid", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.when(F.size("real") == 0, "BLOCK").when(F.col("score") >= floor, "SUPPORTED").otherwise("NOT_SUPPORTED")
    return joined.select("qid", verdict.alias("verdict"), "score")


def answer_veto(answers: DataFrame, seen: DataFrame, scores: DataFrame, floor: float) -> DataFrame:
    """The last word on drafted answers ``qid, claim, chunk_ids, blocked``: ``qid, blocked, reason, score``.

    A draft that blocks itself stays blocked; one that cites nothing seen in its
    own session ``seen(qid, id)`` is blocked, and so is one under the floor.
    """
    cited = answers.select("qid", F.explode_outer("chunk_ids").alias("id")).join(seen.select("qid", "id").distinct(), ["qid", "id"], "left_semi")
    valid = cited.groupBy("qid").agg(F.count("*").alias("valid"))
    rows = answers.select("qid", F.coalesce("blocked", F.lit(False)).alias("self")).join(valid, "qid", "left").join(scores.select("qid", "score"), "qid", "left")
    reason = F.when(F.col("self"), "self").when(F.coalesce("valid", F.lit(0)) == 0, "no_citation").when(F.coalesce("score", F.lit(0.0)) < floor, "low_support")
    return rows.select("qid", reason.isNotNull().alias("blocked"), reason.alias("reason"), F.coalesce("score", F.lit(0.0)).alias("score"))


def dedup_citations(cites: DataFrame, most: int = 5) -> DataFrame:
    """The first citation of each course and section, at most ``most`` for each query, from ``qid, pos, course, section``."""
    first = cites.groupBy("qid", "course", "section").agg(F.min("pos").alias("pos"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).where(F.col("nth") <= most).select("qid", "nth", "course", "section")
