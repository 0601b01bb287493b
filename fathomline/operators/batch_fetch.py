"""Fetching the answers of a batch of requests: all of them are published, or none."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.sources.tables import Tables
from fathomline.sources.versions import Version, VectorStore

_ANSWER = "custom_id string, error string, response struct<status_code:int, body:struct<data:array<struct<embedding:array<double>>>>>"


def reconcile(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``custom_id, shard, state, n_answers, vec``: one row for each request and for each id that nobody asked for.

    Requests are ``custom_id, shard``, responses are lines ``value``. The state
    is ``ok`` if any answer is good, ``failed`` if all are errors, ``missing``
    without one and ``foreign`` without a request. Lines that are no JSON object
    or name no request come together under a null id, as ``unreadable``. Of
    several good answers the least vector counts, so that the order of lines
    doesn't matter; a request that was written twice is one, of its least
    shard. Blank lines are skipped. Requests with a null id are left out.

    Answers are put together before the join, so an id with very many lines is
    one row there.
    """
    said = responses.where(F.length(F.trim("value")) > 0).select(F.from_json("value", _ANSWER).alias("o"))
    vec = F.get(F.col("o.response.body.data"), F.lit(0))["embedding"]
    good = F.col("o.error").isNull() & (F.col("o.response.status_code") == 200) & vec.isNotNull()
    answers = said.groupBy(F.col("o.custom_id").alias("a_id")).agg(F.count("*").alias("n_answers"), F.min(F.when(good, vec)).alias("vec"))
    asked = requests.where("custom_id is not null").groupBy("custom_id").agg(F.min("shard").alias("shard"))
    both = asked.join(answers, F.col("custom_id") == F.col("a_id"), "full_outer")
    state = (
        F.when(F.col("custom_id").isNull(), F.when(F.col("a_id").isNull(), "unreadable").otherwise("foreign"))
        .when(F.col("vec").isNotNull(), "ok")
        .when(F.col("n_answers").isNotNull(), "failed")
        .otherwise("missing")
    )
    return both.select(F.coalesce("custom_id", "a_id").alias("custom_id"), "shard", state.alias("state"), F.coalesce("n_answers", F.lit(0)).alias("n_answers"), "vec")


def shard_states(found: DataFrame) -> DataFrame:
    """``shard, requested, ok, failed, missing, repeated, stray, complete`` of reconciled rows; ids nobody asked for are under a null shard."""
    of = lambda *states: F.count_if(F.col("state").isin(*states))
    counted = found.groupBy("shard").agg(
        of("ok", "failed", "missing").alias("requested"), of("ok").alias("ok"), of("failed").alias("failed"), of("missing").alias("missing"),
        F.count_if((F.col("n_answers") > 1) & F.col("shard").isNotNull()).alias("repeated"), of("foreign", "unreadable").alias("stray"),
    )
    return counted.withColumn("complete", F.col("ok") == F.col("requested"))


@dataclass(frozen=True)
class Fetched:
    """What a fetch did: the version it published, or none and the requests to send again."""

    version: Version | None
    states: DataFrame
    again: DataFrame


def fetch(requests: DataFrame, responses: DataFrame, store: VectorStore, batch: tuple[str, int]) -> Fetched:
    """Publishes the vectors of all requests as one version of the store, or nothing while any request is open.

    ``again`` has the rows of ``requests`` without a good answer, as they came.
    A fetch that is repeated after it was published, under the same batch,
    changes nothing. Answers that nobody asked for are never stored.
    """
    found = Tables(requests.sparkSession, "fetch").write(reconcile(requests, responses))
    still = found.where(F.col("state").isin("failed", "missing")).select("custom_id")
    again = requests.join(still, "custom_id", "left_semi")
    if still.isEmpty():
        version = store.upsert(found.where("state = 'ok'").select(F.col("custom_id").alias("id"), "vec"), batch)
        return Fetched(version, shard_states(found), again)
    return Fetched(None, shard_states(found), again)
