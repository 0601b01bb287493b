"""Near-duplicate documents by bottom-k sketches of word shingles.

Plan
----
1. One pass over the texts hashes every shingle once and keeps per document the
   size of its shingle set, a 128-bit fingerprint of the whole set and the
   ``width`` smallest hash values (the bottom-k sketch). Documents with equal
   sets form a class; only one representative per class goes on.
2. *Star round.* Inverted lists of the first ``probe`` retained values, split by
   size class, nominate their most central member as leader: each representative
   is compared with the leader it shares most lists with. This collapses large groups of
   near copies with one comparison per member.
3. *Exact round.* The remaining pairs are those whose ends lie in different
   components. Lists within one component are done; short lists are joined with
   themselves, and pairs must meet in as many of them as two sets of the asked
   similarity do. A document whose retained values lie mostly in long lists may
   miss its partner there; such documents meet a second time: small ones, whose
   sketch is the whole set, over the least common values, of which similar sets
   always share one; larger ones over combinations of retained values, which
   unlike single values hardly agree among sets that only share a passage.
   In every list only the members outside its main component are compared with
   the others.
4. Maps of 1024 bits, in which two sets differ by no more bits than they differ in
   members, rule out most candidate pairs. The others are estimated from the union
   sketch, and those that may reach the threshold are verified on full sets.

Nothing is capped: long lists only take another route.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytetext as B
from .components import connected_components, with_component
from .storage import Scratch

#: Bits of the map of a set: the maps of two sets differ in no more bits than the sets differ in members.
_BITS = 1024
_SLOTS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and each text's offsets in them.

    Words are runs of bytes outside white space, with A-Z lower-cased. A text
    with fewer than ``words`` words has its whole sequence as one shingle; one
    without words has none.
    """
    data, offsets = B.buffer(texts)
    data = B.LOWER[data]
    starts, ends, first = B.word_spans(data, offsets, B.WHITESPACE)
    h = B.span_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    total = int(count.sum())
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + first[:-1][owner]
    size = np.minimum(n, words)[owner]
    acc = size.astype(np.uint64)
    for j in range(words):
        live = j < size
        acc[live] += h[at[live] + j] * _SLOTS[j]
    values = B.mix(acc).view(np.int64)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(total, bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _sketcher(words: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in B.passes(whole, "text"):
                values, at = shingle_sets(batch.column("text"), words)
                n = np.diff(at)
                u = values.view(np.uint64)
                f1, f2 = _fingerprints(values, at)
                rank = np.arange(len(values)) - np.repeat(at[:-1], n)
                marks = np.zeros((len(n), _BITS), np.uint8)
                marks[np.repeat(np.arange(len(n)), n), (B.mix(u + _SLOTS[42]) % np.uint64(_BITS)).astype(np.int64)] = 1
                bits = np.packbits(marks, axis=1).view("<i8")
                kept = np.concatenate([[0], np.cumsum(np.minimum(n, width))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), _lists(values[rank < width], kept), _lists(bits.ravel(), np.arange(len(n) + 1) * (_BITS // 64))],
                    names=["id", "n", "f1", "f2", "sketch", "bits"],
                )

    return run


#: Larger sets that hold many common values meet over combinations: in each of _DEALS ways the sketch is dealt into _PARTS, and the _TAKEN smallest
#: values of a part are one key. At a similarity of 0.75 a key of two sets of one size agrees with probability 0.42; where one set extends the other it is
#: 0.32, as the larger set's sketch may end inside a part. All 48 keys fail about once in a hundred million such pairs.
_DEALS, _PARTS, _TAKEN = 2, 24, 3


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of combined values of each sketch."""
    for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
        lists = batch.column("sketch")
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        values = np.asarray(lists.flatten()).astype(np.int64)
        u, owner = values.view(np.uint64), np.repeat(np.arange(len(n)), n)
        rank_of = np.arange(len(values))  # ascending within a sketch
        keys, owners = [], []
        for deal in range(_DEALS):
            part = (B.mix(u ^ _SLOTS[deal + 8]) >> np.uint64(11)) % np.uint64(_PARTS)
            group = owner * _PARTS + part.astype(np.int64)
            order = np.lexsort((rank_of, group))
            g = group[order]
            heads = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
            size = np.diff(np.append(heads, len(g)))
            nth = np.arange(len(g)) - np.repeat(heads, size)
            mixed = np.where(nth < _TAKEN, B.mix(u[order] ^ _SLOTS[20]) * _SLOTS[np.minimum(nth, _TAKEN) + 24], np.uint64(0))
            if len(heads):
                keys.append(B.mix(np.add.reduceat(mixed, heads) + g[heads].astype(np.uint64) % np.uint64(_PARTS) * _SLOTS[50] + np.uint64(deal)))
                owners.append(g[heads] // _PARTS)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        who = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(who, kind="stable")
        ends = np.searchsorted(who[order], np.arange(len(n) + 1))
        own = [batch.column(c) for c in ("cid", "n", "comp", "bits")]
        yield pa.RecordBatch.from_arrays([*own, _lists(key[order].view(np.int64), ends)], names=["cid", "n", "comp", "bits", "keys"])


def _fingerprints(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each whole set; 0 for an empty one."""
    u, some = values.view(np.uint64), np.diff(at) > 0
    f1, f2 = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
    if some.any():
        f1[some] = np.add.reduceat(B.mix(u ^ _SLOTS[40]), at[:-1][some])
        f2[some] = np.bitwise_xor.reduceat(B.mix(u ^ _SLOTS[41]), at[:-1][some])
    return f1.view(np.int64), f2.view(np.int64)


def _full_sets(words: int, keep: tuple[str, ...]):
    """The sets of the rows whose text has the fingerprint asked for; other versions of the same id have another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in B.passes(whole, "text"):
                values, at = shingle_sets(batch.column("text"), words)
                f1, f2 = _fingerprints(values, at)
                meant = pa.array((f1 == np.asarray(batch.column("f1"))) & (f2 == np.asarray(batch.column("f2"))))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(meant) for k in keep), _lists(values, at).filter(meant)], names=[*keep, "items"])

    return run


def _confirm(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("xs"), batch.column("ys")
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = np.intersect1d(p, q, assume_unique=True).size
                linked[i] = denominator * both >= numerator * (p.size + q.size - both)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


class NearDuplicates:
    """Classes and components of near-duplicate texts.

    ``find(docs)`` returns one row per input row: ``doc_id, n_shingles,
    component_id, kept``.

    Defined cases: a null or empty text, or one of white space only, has an
    empty set and links with nothing. A null id gets a null component and is
    kept. Rows that repeat an id are versions of one document: each is returned,
    each text's links count, and they share a component. Equal sets are linked,
    ties go to the smallest id. An empty table gives no rows. Other columns are
    not read.

    A class of equal sets goes by the number of one of its rows (``cid``), not
    by an id, which several texts may share.
    """

    def __init__(self, words: int = 5, numerator: int = 75, denominator: int = 100, width: int = 96, probe: int = 16, spread: int = 32):
        self.words, self.numerator, self.denominator = words, numerator, denominator
        self.width, self.probe, self.spread = width, probe, spread
        self.ratio = numerator / denominator

    # How far chance may carry a binomial share before it is ruled out: about one in a million.
    def _slack(self, k: int) -> int:
        p = 1 - self.ratio
        return min(k, math.ceil(k * p + 5.2 * math.sqrt(k * p * (1 - p))))

    def _spared(self, width: int) -> Column:
        """Of the first ``width`` retained values, how many a similar set's first ones may lack.

        Exact where both sketches must be whole sets, else up to the slack.
        """
        exact = F.col("n") - F.ceil(F.col("n") * self.ratio)
        whole = F.col("n") * self.denominator <= width * self.numerator
        return F.when(whole, exact).otherwise(F.lit(self._slack(width))).cast("long")

    def find(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        spark = docs.sparkSession
        scratch = Scratch(spark, "near-duplicates")
        source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        schema = "id long, n long, f1 long, f2 long, sketch array<long>, bits array<long>"
        sketched = scratch.save(source.mapInArrow(_sketcher(self.words, self.width), schema).withColumn("row", F.monotonically_increasing_id()))
        usable = sketched.where("id is not null and n > 0")
        key = ["n", "f1", "f2"]
        # Written first, so that the joins below have plain shuffles on both sides, of which Spark can split a class of very many copies.
        classes = scratch.save(usable.groupBy(*key).agg(F.min("row").alias("cid"), F.min("id").alias("least")))
        own = F.col("n") > 0
        base = scratch.save(
            sketched.select("id", "row", *key).join(classes, key, "left").select("id", "n", F.when(own, F.col("cid")).otherwise(F.col("row")).alias("class"), F.when(own, F.col("least")).otherwise(F.col("id")).alias("least"))
        )
        reps = scratch.save(usable.join(classes.select("cid", "least"), F.col("row") == F.col("cid")).select("cid", "id", "least", "n", "f1", "f2", "sketch", "bits"))
        scratch.drop(sketched, classes)

        stars = scratch.save(self._star_pairs(reps, scratch))
        scratch.keep(base, reps, stars)
        links = scratch.save(self._verify(stars, reps, source, scratch))
        first = scratch.save(connected_components(links, scratch))
        scratch.keep(base, reps, links, first)
        rest = scratch.save(self._rest_pairs(reps, first, scratch))
        scratch.keep(base, reps, links, rest)
        more = scratch.save(self._verify(rest, reps, source, scratch))
        scratch.keep(base, links, more)
        found = scratch.save(with_component(base, links.union(more), scratch))
        scratch.keep(found)
        kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
        return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))

    def _close_sizes(self, x: str, y: str) -> Column:
        return F.least(x, y) * self.denominator >= F.greatest(x, y) * self.numerator

    def _possible(self, x: str, y: str) -> Column:
        """Exact bound on the members that only one set has; ``x`` and ``y`` are column prefixes."""
        n, m = F.col(f"{x}n"), F.col(f"{y}n")
        apart = sum(F.bit_count(F.get(f"{x}bits", F.lit(i)).bitwiseXOR(F.get(f"{y}bits", F.lit(i)))) for i in range(_BITS // 64))
        # With J the similarity, the members that differ are at most (1 - J) / (1 + J) of both sizes together.
        return apart * (self.denominator + self.numerator) <= (n + m) * (self.denominator - self.numerator)

    def _star_pairs(self, reps: DataFrame, scratch: Scratch) -> DataFrame:
        """At most one pair per representative: with the leader of most of its lists.

        A list is led by its most central member, the one whose own lists are
        longest: among near copies that's the text they were made from. Of equal
        ones it is that of the smallest id, as originals tend to come first.
        """
        step = math.log(1 / self.ratio)
        lists = reps.select("cid", "least", "n", F.explode(F.slice("sketch", 1, self.probe)).alias("v"))
        long = lists.groupBy("v").agg(F.count("*").alias("long")).where("long > 1")
        lists = scratch.save(lists.join(long, "v"))
        central = lists.groupBy("cid", "n").agg(F.sum("long").alias("weight"))
        lists = lists.join(central, ["cid", "n"]).select("v", "cid", "least", "n", "weight", F.floor(F.log("n") / step).alias("size"))
        leaders = (
            lists.groupBy("v", "size")
            .agg(F.max(F.struct("weight", (-F.col("least")).alias("ni"), (-F.col("cid")).alias("nc"), "n")).alias("lead"))
            .select("v", "size", (-F.col("lead.nc")).alias("a"), F.col("lead.ni").alias("ni"), F.col("lead.n").alias("lead_n"))
        )
        asked = lists.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") - 1)))
        return (
            asked.join(leaders, ["v", "size"])
            .where((F.col("a") != F.col("cid")) & self._close_sizes("n", "lead_n"))
            .groupBy("cid", "a")
            .agg(F.count("*").alias("shared"), F.min("n").alias("n"), F.first("ni").alias("ni"))
            .where(F.col("shared") * 3 >= F.least(F.col("n"), F.lit(self.probe)))
            .groupBy("cid")
            .agg(F.max(F.struct("shared", "ni", (-F.col("a")).alias("na"))).alias("best"))
            .select((-F.col("best.na")).alias("a"), F.col("cid").alias("b"))
        )

    def _rest_pairs(self, reps: DataFrame, components: DataFrame, scratch: Scratch) -> DataFrame:
        """Candidate pairs of different components, by the lists of the exact round."""
        width = max(8, self.width // 3)
        size = F.least(F.col("n"), F.lit(width))
        placed = reps.join(components, reps.cid == components.node, "left").select("cid", "n", "bits", "sketch", F.coalesce("component", "cid").alias("comp"))
        lists = placed.select("cid", "n", "comp", F.explode(F.slice("sketch", 1, width)).alias("v"))
        lists = scratch.save(self._mixed(lists, ["v"]))
        common = scratch.save(lists.where(F.col("long") > self.spread).groupBy("cid", "n").agg(F.count("*").alias("common")))
        rare = lists.where(F.col("long") <= self.spread).join(common, ["cid", "n"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
        # Two similar sets share all but the spared values, of which only the common ones aren't in these lists.
        rare = rare.withColumn("share", size - self._spared(width))
        found = [scratch.save(self._pairs_within(rare, scratch))]

        dense = common.where(size - F.col("common") <= self._spared(width)).select("cid", "n")
        pool = scratch.save(placed.join(dense, ["cid", "n"], "left_semi"))
        # Whole sets: they must share one of the values that all but the spared ones leave, the least common first.
        whole = self._mixed(pool.where(F.col("n") <= self.width).select("cid", "n", "bits", "comp", F.explode("sketch").alias("v")), ["v"])
        order = Window.partitionBy("cid", "n").orderBy("long", "v")
        private = F.col("n") - F.count("*").over(Window.partitionBy("cid", "n"))
        least = scratch.save(whole.withColumn("rank", F.row_number().over(order) + private).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * self.ratio) + 1))
        found.append(scratch.save(self._pairs_within(least.withColumns({"share": F.lit(1), "common": F.lit(0)}), scratch)))
        # Larger sets: the smallest values in parts of the sketch, taken together.
        large = pool.where(F.col("n") * self.denominator > self.width * self.numerator)
        keyed = large.select("cid", "n", "comp", "bits", "sketch").mapInArrow(_combine, "cid long, n long, comp long, bits array<long>, keys array<long>")
        keyed = self._mixed(keyed.select("cid", "n", "comp", "bits", F.explode("keys").alias("v")), ["v"])
        found.append(scratch.save(self._pairs_within(keyed.withColumns({"share": F.lit(1), "common": F.lit(0)}), scratch)))
        return found[0].union(found[1]).union(found[2]).distinct()

    @staticmethod
    def _mixed(lists: DataFrame, key: list[str]) -> DataFrame:
        """The lists that reach more than one component, with their length and the component of most of their members."""
        parts = lists.groupBy(*key, "comp").agg(F.count("*").alias("rows"))
        about = parts.groupBy(*key).agg(F.count("*").alias("reach"), F.sum("rows").alias("long"), F.max_by("comp", F.struct("rows", "comp")).alias("main"))
        return lists.join(about.where("reach > 1").drop("reach"), key)

    def _pairs_within(self, lists: DataFrame, scratch: Scratch) -> DataFrame:
        """Pairs of different components that meet in as many lists as similar sets must.

        The members outside a list's main component are compared with all. Every
        member carries the values of its lists (at most as many as a sketch has),
        so that a pair is told apart where it first meets, the list of the
        smallest value that both hold, and leaves the join once instead of once
        for each list.
        """
        own = [c for c in ("cid", "n", "comp", "bits", "share", "common") if c in lists.columns]
        members = scratch.save(lists.groupBy("cid").agg(*[F.first(c).alias(c) for c in own[1:]], F.collect_list("v").alias("vs"), F.collect_list("main").alias("mains")))
        each = members.select(*own, "vs", F.explode(F.arrays_zip(F.col("vs").alias("v"), F.col("mains").alias("main"))).alias("list"))
        x = each.where("comp <> list.main").select(F.col("list.v").alias("v"), *[F.col(c).alias(f"x_{c}") for c in (*own, "vs")])
        y = each.select(F.col("list.v").alias("v"), F.col("list.main").alias("main"), *[F.col(c).alias(f"y_{c}") for c in (*own, "vs")])
        once = (F.col("y_comp") == F.col("main")) | (F.col("x_cid") < F.col("y_cid"))
        may = once & (F.col("x_comp") != F.col("y_comp")) & self._close_sizes("x_n", "y_n")
        if "bits" in own:
            may = may & self._possible("x_", "y_")
        met = F.array_intersect("x_vs", "y_vs")
        needed = F.greatest("x_share", "y_share") - F.least("x_common", "y_common")
        may = may & (F.size(met) >= needed) & (F.array_min(met) == F.col("v"))
        return x.join(y, "v").where(may).select(F.least("x_cid", "y_cid").alias("a"), F.greatest("x_cid", "y_cid").alias("b"))

    def _verify(self, pairs: DataFrame, reps: DataFrame, source: DataFrame, scratch: Scratch) -> DataFrame:
        """The pairs that reach the threshold on full sets."""
        # The maps first: most candidates end there, and their sketches are never moved.
        maps = lambda end, name: reps.select(F.col("cid").alias(end), F.col("n").alias(f"{name}n"), F.col("bits").alias(f"{name}bits"))
        pairs = pairs.join(maps("a", "x_"), "a").join(maps("b", "y_"), "b").where(self._possible("x_", "y_")).select("a", "b").distinct()
        x = reps.select(F.col("cid").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("xs"))
        y = reps.select(F.col("cid").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("ys"))
        union = F.slice(F.array_sort(F.array_union("xs", "ys")), 1, self.width)
        seen = scratch.save(pairs.join(x, "a").join(y, "b").select(
            "a", "b", (F.greatest("an", "bn") <= self.width).alias("whole"), F.size(union).alias("of"),
            F.size(F.array_intersect(union, F.array_intersect("xs", "ys"))).alias("both"), F.size(F.array_union("xs", "ys")).alias("all"), F.size(F.array_intersect("xs", "ys")).alias("meet"),
        ))
        sure = seen.where("whole").where(F.col("meet") * self.denominator >= F.col("all") * self.numerator).select("a", "b")
        likely = seen.where("not whole").where(F.col("both") >= F.col("of") - self._slack(self.width)).select("a", "b").distinct()
        text_of = lambda end: reps.select(F.col("cid").alias(end), "id", "f1", "f2")
        left = source.join(likely.join(text_of("b"), "b"), "id").select("a", "b", "f1", "f2", "text")
        left = left.mapInArrow(_full_sets(self.words, ("a", "b")), "a long, b long, items array<long>").withColumnRenamed("items", "ys")
        right = source.join(likely.select("a").distinct().join(text_of("a"), "a"), "id").select("a", "f1", "f2", "text")
        right = right.mapInArrow(_full_sets(self.words, ("a",)), "a long, items array<long>").withColumnRenamed("items", "xs")
        checked = left.join(right, "a").select("a", "b", "xs", "ys").mapInArrow(_confirm(self.numerator, self.denominator), "a long, b long")
        return sure.union(checked)
