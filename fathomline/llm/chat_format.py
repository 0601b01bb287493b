"""Chat transcripts from cumulative snapshots.

Chat logs often store every state of a conversation: each longer one begins
with all turns of the shorter ones. Rolling hashes of the turns up to each
position identify every prefix; a conversation whose whole hash is a proper
prefix of another one's is dropped by an anti-join, equal ones are collapsed,
and only the maximal ones are rendered.

Positions and rolling hashes are computed in two levels, within stretches of
turns and over the stretches' totals, so that even one conversation with very
many turns is spread over tasks until its text is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Scratch

#: Turn numbers that one stretch spans.
STRETCH = 1024


class ChatFormatter:
    """``format(turns)`` returns ``conv_id, n_turns, text`` for every maximal conversation.

    A turn is rendered as ``<|role|>``, a line feed, its text, ``<|end|>`` and a
    line feed; turns follow by number, then role, then text.

    Defined cases: null roles and texts are empty ones, a null turn number comes
    first. Repeated rows are turns of their own. Of equal conversations the one
    with the smallest id stays. A turn with a null ``conv_id`` is a conversation
    of its own, with a null id. An empty table gives no rows. Other columns are
    not read.
    """

    def __init__(self, head: str = "<|", neck: str = "|>\n", tail: str = "<|end|>\n"):
        self.head, self.neck, self.tail = head, neck, tail

    def _segment(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.head), F.coalesce(role, F.lit("")), F.lit(self.neck), F.coalesce(text, F.lit("")), F.lit(self.tail))

    def rolling(self, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
        """Every turn with its conversation's key, its position and the hashes ``h1, h2`` of all turns up to it."""
        rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), self._segment(F.col(role).cast("string"), F.col(text).cast("string")).alias("segment"))
        lone = F.concat_ws(":", F.lit("lone"), F.monotonically_increasing_id())
        rows = rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), lone)).withColumn("stretch", F.floor(F.col("turn") / STRETCH))
        within = Window.partitionBy("key", "stretch").orderBy(F.asc_nulls_first("turn"), "segment")
        rows = rows.withColumn("place", F.row_number().over(within))
        counts = rows.groupBy("key", "stretch").agg(F.count("*").alias("n"))
        earlier = Window.partitionBy("key").orderBy(F.asc_nulls_first("stretch")).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(F.col("key").alias("k"), F.col("stretch").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        rows = rows.join(counts, (F.col("key") == F.col("k")) & F.col("stretch").eqNullSafe(F.col("s"))).withColumn("pos", F.col("before") + F.col("place")).drop("k", "s", "before", "place")
        rows = rows.withColumns({"x1": F.xxhash64("pos", "segment"), "x2": F.xxhash64("segment", F.lit(7), "pos")})
        totals = rows.groupBy("key", "stretch").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
        totals = totals.select(F.col("key").alias("k"), F.col("stretch").alias("s"), *[F.coalesce(F.bit_xor(f"t{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
        upto = Window.partitionBy("key", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.join(totals, (F.col("key") == F.col("k")) & F.col("stretch").eqNullSafe(F.col("s")))
        return rows.select("key", "conv_id", "pos", "segment", *[F.bit_xor(f"x{i}").over(upto).bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)])

    def format(self, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
        rows = Scratch(turns.sparkSession, "chat").save(self.rolling(turns, conv, turn, role, text))
        last = rows.groupBy("key").agg(F.max("pos").alias("n"), F.max_by(F.struct("conv_id", "h1", "h2"), "pos").alias("end")).select("key", "n", "end.*")
        whole = last.groupBy("n", "h1", "h2").agg(F.min_by("key", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("key"), F.min("conv_id").alias("conv_id"))
        ends = last.select("key", F.col("n"))
        inner = rows.join(ends, "key").where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
        maximal = whole.join(inner, ["n", "h1", "h2"], "left_anti").select("key", "conv_id", "n")
        told = rows.select("key", "pos", "segment").join(maximal, "key")
        return (
            told.groupBy("key", "conv_id", "n")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "segment"))).alias("turns"))
            .select("conv_id", F.col("n").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("text"))
        )

