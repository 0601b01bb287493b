"""Chat sessions: the course that a user has chosen holds for the messages that follow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from fathomline.sources.tables import Tables

from .catalog import course_match
from .messages import route

#: A stream sends the names of the courses to its tasks; more than this many is an error.
MOST_COURSES = 100_000


def _outcome() -> Column:
    """What a routed message leads to, given ``picked``, its own choice, and ``course``, the one that holds after it."""
    asks = F.col("argument") == ""
    return (
        F.when((F.col("action") == "use") & asks, "usage")
        .when(F.col("action") == "use", F.when(F.col("picked").isNull(), "unknown").otherwise("chosen"))
        .when((F.col("action") == "teach") & F.col("course").isNull(), "choose_first")
        .when((F.col("action") == "teach") & asks, "usage")
        .otherwise("done")
    )


def _routed(messages: DataFrame) -> DataFrame:
    return messages.withColumn("r", route(F.col("t"))).select("usr", "turn", "t", "r.action", "r.argument")


def sessions(messages: DataFrame, courses: DataFrame) -> DataFrame:
    """``usr, turn, t, action, argument, course, outcome`` of messages ``usr, turn, t``; ``courses`` are ``course, n, first``.

    ``/use`` chooses the course that ``course_match`` finds; without one, or
    without a name, the earlier choice holds. Messages of one user and turn
    go by their text, null turns come first, and all without a user share a
    session.

    A busy user isn't one task: messages are dealt by ranges of user and turn,
    the last choice is found within each range, and only one row for each user
    and range is carried over.
    """
    spark = messages.sparkSession
    routed = _routed(messages)
    wishes = routed.where("action = 'use' and argument <> ''").select(F.col("argument").alias("qid"), F.col("argument").alias("q")).distinct()
    scratch = Tables(spark, "sessions")
    picks = course_match(scratch.write(wishes), courses).select(F.col("qid").alias("wish"), F.col("course").alias("picked"))
    own = F.when((F.col("action") == "use") & (F.col("argument") != ""), F.col("argument"))
    # Messages that choose nothing are spread by keys of their own, which match no wish.
    key = F.coalesce(own, F.concat(F.lit("\n"), F.xxhash64("usr", "turn").cast("string")))
    told = routed.withColumn("key", key).join(picks, F.col("key") == F.col("wish"), "left").drop("key", "wish")
    dealt = told.repartitionByRange("usr", "turn", "t").withColumn("lot", F.spark_partition_id())
    dealt = scratch.write(dealt)
    ends = dealt.where("picked is not null").groupBy("usr", "lot").agg(F.max_by("picked", F.struct("turn", "t")).alias("end"))
    # One row for each user and range; the choices of the ranges before are carried over.
    parts = dealt.select("usr", "lot").distinct().alias("p").join(ends.alias("e"), F.col("p.usr").eqNullSafe(F.col("e.usr")) & (F.col("p.lot") == F.col("e.lot")), "left")
    earlier = Window.partitionBy("usr").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("p.usr", "p.lot", "end").withColumn("before", F.last("end", ignorenulls=True).over(earlier)).select(F.col("usr").alias("c_usr"), F.col("lot").alias("c_lot"), "before")
    within = Window.partitionBy("usr", "lot").orderBy("turn", "t").rowsBetween(Window.unboundedPreceding, 0)
    here = dealt.withColumn("here", F.last("picked", ignorenulls=True).over(within))
    joined = here.join(carried, F.col("usr").eqNullSafe(F.col("c_usr")) & (F.col("lot") == F.col("c_lot"))).withColumn("course", F.coalesce("here", "before"))
    return joined.select("usr", "turn", "t", "action", "argument", "course", _outcome().alias("outcome"))


def stream_sessions(messages: DataFrame, courses: DataFrame) -> DataFrame:
    """The same for a stream of messages with a bigint ``usr`` and ``turn``: each user's choice is kept as state.

    Within a micro-batch a user's messages go by turn and text; a message that
    comes in a later batch counts as later. Messages without a user are left
    out, since they have no state to keep. The courses are read once, when the
    stream is set up: up to MOST_COURSES names.
    """
    listed = courses.orderBy(F.desc("n"), "first").select("course").limit(MOST_COURSES + 1).toPandas()["course"].tolist()
    if len(listed) > MOST_COURSES:
        raise ValueError(f"more than {MOST_COURSES} courses")
    exact = {name.lower(): name for name in reversed(listed)}

    def pick(wish: str) -> str | None:
        low = wish.lower()
        return exact.get(low) or next((name for name in listed if low in name.lower()), None)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["turn", "t"], na_position="first")
        picked, course = [], []
        for action, argument in zip(rows["action"], rows["argument"]):
            own = pick(argument) if action == "use" and argument else None
            held = own or held
            picked.append(own)
            course.append(held)
        if held is not None:
            state.update((held,))
        yield rows.assign(picked=picked, course=course)[["usr", "turn", "t", "action", "argument", "picked", "course"]]

    text = "t string, action string, argument string, picked string, course string"
    routed = _routed(messages.where("usr is not null"))
    followed = routed.groupBy("usr").applyInPandasWithState(follow, f"usr bigint, turn bigint, {text}", "course string", "append", GroupStateTimeout.NoTimeout)
    return followed.select("usr", "turn", "t", "action", "argument", "course", _outcome().alias("outcome"))
