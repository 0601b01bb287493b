"""Near-duplicate vectors by random-hyperplane signs, exact cosines and components.

Each vector's signs against ``tables * bits`` random hyperplanes give it one
bucket in every table. Pairs that share a bucket are met once, in the
first table where they meet, and only if all their signs together leave the
asked cosine possible; the cosine itself is computed in double precision.
Equal vectors are compared as one, with their number.

With 16 bits and 24 tables a pair at cosine 0.95 meets with probability 0.992,
and closer pairs more surely still.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import with_component
from .storage import Scratch


def _signer(tables: int, bits: int, seed: int):
    """Words of 64 signs for each vector; null where a vector can't be compared."""

    def run(vectors: pa.Array) -> pa.Array:
        n = len(vectors)
        words = tables * bits // 64
        signs = np.zeros((n, words), np.uint64)
        size = np.zeros(n, np.int64)
        valid = vectors.is_valid().to_numpy(zero_copy_only=False)
        length = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.asarray(vectors.offsets)[:-1]
        values = vectors.values.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
        for d in np.unique(length[valid & (length > 0)]):
            at = np.flatnonzero(valid & (length == d))
            x = values[starts[at][:, None] + np.arange(d)]
            top = np.abs(x).max(axis=1)
            fine = np.isfinite(top) & (top > 0)
            at, x = at[fine], x[fine] / top[fine][:, None]
            planes = np.random.default_rng(seed + int(d)).standard_normal((int(d), tables * bits))
            up = np.packbits(x @ planes > 0, axis=1, bitorder="little")
            signs[at] = up.view("<u8") if len(at) else signs[at]
            size[at] = d
        ok = size > 0
        offsets = np.concatenate([[0], np.cumsum(np.where(ok, words, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(signs[ok].view(np.int64).ravel()), mask=pa.array(~ok))

    return F.arrow_udf(run, "array<bigint>")


class EmbeddingDuplicates:
    """``find(vectors)`` returns one row per input row: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other rows linked directly.

    Defined cases: vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing; vectors of different lengths don't
    link. Repeated rows are linked with each other like other equal vectors, and
    so are near vectors of one id; of rows that share an id all are returned,
    with their own links and that id's component. Rows with
    a null id count among no links, have no component and are kept. An empty
    table gives no rows. Other columns are not read.
    """

    def __init__(self, cosine: float = 0.95, tables: int = 24, bits: int = 16, seed: int = 1):
        if 64 % bits or tables * bits % 64:
            raise ValueError("bits must divide 64, and all signs must fill words of 64")
        self.cosine, self.tables, self.bits, self.seed = cosine, tables, bits, seed

    def _part(self, word: Column, table: int) -> Column:
        return F.shiftrightunsigned(word, (table * self.bits) % 64).bitwiseAND(F.lit((1 << self.bits) - 1))

    def links(self, classes: DataFrame, scratch: Scratch) -> DataFrame:
        """Pairs ``a, b`` of the classes ``(cid, vec, n)`` from the asked cosine on, with the members of both.

        Only keys, class numbers and signs are dealt to the buckets; the vectors
        are fetched for the pairs that the signs leave.
        """
        signed = scratch.save(classes.select("cid", _signer(self.tables, self.bits, self.seed)("vec").alias("signs")).where("signs is not null"))
        per_word = 64 // self.bits
        keys = F.array(*[self._part(F.get("signs", F.lit(t // per_word)), t) for t in range(self.tables)])
        buckets = signed.select("cid", "signs", F.posexplode(keys).alias("t", "key"))
        x, y = (buckets.select("t", "key", F.col("cid").alias(f"{side}_cid"), F.col("signs").alias(f"{side}_signs")) for side in "xy")
        differ = [F.get("x_signs", F.lit(w)).bitwiseXOR(F.get("y_signs", F.lit(w))) for w in range(self.tables // per_word)]
        first = F.coalesce(*[F.when(self._part(differ[t // per_word], t) == 0, F.lit(t)) for t in range(self.tables)])
        total = self.tables * self.bits
        apart = math.acos(self.cosine) / math.pi
        most = math.ceil(total * apart + 5.5 * math.sqrt(total * apart * (1 - apart)))
        possible = (F.col("x_cid") < F.col("y_cid")) & (sum(F.bit_count(d) for d in differ) <= most) & (F.col("t") == first)
        pairs = x.join(y, ["t", "key"]).where(possible).select(F.col("x_cid").alias("a"), F.col("y_cid").alias("b"))
        length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
        held = classes.select("cid", "vec", "n", length.alias("length"))
        x, y = (held.select(F.col("cid").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("vec", "n", "length")]) for end in "ab")
        dot = F.aggregate(F.zip_with("a_vec", "b_vec", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
        near = F.when(F.size("a_vec") == F.size("b_vec"), dot >= self.cosine * F.col("a_length") * F.col("b_length")).otherwise(False)
        return pairs.join(x, "a").join(y, "b").where(near).select("a", "b", F.col("a_n").alias("an"), F.col("b_n").alias("bn"))

    def find(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        scratch = Scratch(vectors.sparkSession, "embedding-duplicates")
        comparable = F.coalesce(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)) & F.exists("vec", lambda v: v != 0), F.lit(False))
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).select("id", F.when(comparable, F.col("vec")).alias("vec"))
        rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))
        classes = scratch.save(rows.where("id is not null and vec is not null").groupBy("vec").agg(F.min("row").alias("cid"), F.min("id").alias("least"), F.count("*").alias("n")))
        own = F.col("vec").isNotNull() & F.col("id").isNotNull()
        members = scratch.save(
            rows.join(classes, "vec", "left").select(
                "id", F.when(own, F.col("cid")).otherwise(F.col("row")).alias("class"), F.when(own, F.col("least")).otherwise(F.col("id")).alias("least"), F.when(own, F.col("n")).otherwise(F.lit(1)).alias("n")
            )
        )
        links = scratch.save(self.links(classes, scratch))
        counts = links.select(F.col("a").alias("c"), F.col("bn").alias("m")).union(links.select(F.col("b").alias("c"), F.col("an").alias("m")))
        counts = scratch.save(counts.groupBy("c").agg(F.sum("m").alias("others")))
        scratch.keep(members, links, counts)
        placed = scratch.save(with_component(members, links, scratch).join(counts, F.col("class") == F.col("c"), "left"))
        scratch.keep(placed)
        kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
        return placed.select(
            F.col("id").alias("vec_id"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.col("component").alias("component_id"), kept.alias("kept")
        )
