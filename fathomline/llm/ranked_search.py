"""Ranked lexical search: postings bucketed by term, joined with the items' terms.

Every document's terms are counted where it lies, over its whole text. Postings
of the terms that are asked for are written bucketed by term; a frequent term is
dealt over several buckets (``salt``), so that no task holds one word's whole
list. A search joins the items' terms with them, scores each match as a whole
number, sums by item and document, and takes the first ``k`` rows of a window.

Frequent terms would make a row for nearly every pair of an item and a document.
They needn't: a first search by each item's rarest terms gives documents whose
full scores are a threshold that ``k`` documents reach. Terms whose largest
possible contributions together stay below it can't bring a document in, so only
the others are joined with the postings, and the frequent terms' contributions
are added for the documents that can still reach the threshold. The results are
those of the full join: a document is left out only if an upper bound of its
score is smaller than ``k`` scores.

All that depends on the numbers of documents and terms is 64-bit arithmetic, and
no pair of an item and a document is made that holds none of the item's telling
terms.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytetext as B
from .storage import Scratch

#: Bytes of upper-case letters become lower-case, bytes that separate terms become blanks. Bytes of other scripts stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if chr(b).isalnum() and b < 0x80 or b >= 0x80 else 0x20 for b in range(256))
#: Up to so many distinct asked terms are sent to the tasks that read texts; with more, those tasks pass all terms on.
SENT_TERMS = 1 << 20
#: About as many postings of one term lie in one bucket.
BUCKET_ROWS = 1 << 18


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased, with repeats."""
    return text.translate(_FOLD).split()


def _counter(vocabulary):
    """Per document: its number of terms, and its asked terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = vocabulary.value if vocabulary else None
        for whole in batches:
            for batch in B.passes(whole, "text"):
                sizes, terms, counts = [], [], []
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    words = terms_of(text or b"")
                    sizes.append(len(words))
                    held = Counter(words) if asked is None else Counter(filter(asked.__contains__, words))
                    terms.append(list(held))
                    counts.append(list(held.values()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                    names=["id", "n", "terms", "counts"],
                )

    return run


class RankedSearch:
    """``search(items, docs)`` returns ``item_id, rank, doc_id, score``: the ``k`` best documents of each item.

    ``N`` documents have terms, ``L`` terms in all; a document of ``n`` terms
    has ``m = 100 - 25 + 25 * n * N div L``. A term that ``df`` documents hold
    weighs ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``; where it occurs
    ``tf`` times it adds ``w * (10^9 * tf div (1000 * tf + 12 * m))``, for every
    repeat in the item again. Equal scores stand by ascending id.

    Defined cases: null and empty texts have no terms; as documents they aren't
    counted, as items they return nothing. Documents with a null id are counted
    and not returned; items with a null id are left out. Rows that share an id
    are each a document and may each be returned (equal ranks are told apart by
    an arbitrary row number); items that share an id are asked as one, of all
    their texts. Scores of 0 aren't returned. Empty tables give no rows. Other
    columns are not read.
    """

    def __init__(self, k: int = 20, seeds: int = 2048, tried: int = 100, buckets: int | None = None):
        #: Postings by which an item's first search starts, and documents of it that are scored in full. Both only move the threshold.
        self.k, self.seeds, self.tried, self.buckets = k, seeds, max(tried, k), buckets

    def asked(self, items: DataFrame, item_col: str, text_col: str) -> DataFrame:
        """``item_id, term, qtf``."""
        rows = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        counted = rows.mapInArrow(_counter(None), "id long, n long, terms array<string>, counts array<long>")
        pairs = counted.select(F.col("id").alias("item_id"), F.explode(F.arrays_zip("terms", "counts")).alias("t"))
        return pairs.groupBy("item_id", F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("qtf"))

    def forward(self, docs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``row, doc_id, n, terms, counts`` of every document, with the asked terms."""
        vocabulary = asked.select("term").distinct()
        few = vocabulary.limit(SENT_TERMS + 1).count() <= SENT_TERMS
        sent = docs.sparkSession.sparkContext.broadcast(frozenset(t.encode() for t in vocabulary.toArrow().column("term").to_pylist())) if few else None
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        counted = rows.mapInArrow(_counter(sent), "id long, n long, terms array<string>, counts array<long>")
        return counted.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("doc_id"), "n", "terms", "counts")

    def _bucketed(self, posts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """The postings as a table bucketed by term and salt, in the shared folder."""
        buckets = self.buckets or int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = posts.repartition(buckets, "term", "salt")
        dealt.write.bucketBy(buckets, "term", "salt").sortBy("term").option("path", f"{scratch.root}/{name}").format("parquet").saveAsTable(name)
        return posts.sparkSession.table(name)

    def search(self, items: DataFrame, docs: DataFrame, item_col: str = "item_id", item_text_col: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        scratch = Scratch(docs.sparkSession, "ranked-search")
        asked = scratch.save(self.asked(items, item_col, item_text_col))
        forward = scratch.save(self.forward(docs, asked, id_col, text_col))
        documents, total = forward.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        norm = F.expr(f"75 + (25 * n * {documents}L) div {total or 1}L")
        part = F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)")

        def matches(rows: DataFrame) -> DataFrame:
            """``row, doc_id, term, part`` of documents' asked terms."""
            each = rows.select("row", "doc_id", norm.alias("m"), F.explode(F.arrays_zip("terms", "counts")).alias("t"))
            return each.select("row", "doc_id", F.col("t.terms").alias("term"), F.col("t.counts").alias("tf"), "m").select("row", "doc_id", "term", part.alias("part"))

        known = scratch.save(matches(forward).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most")))
        weight = F.floor(1000 * F.log((2.0 * documents + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
        salts = F.ceil(F.col("df") / BUCKET_ROWS).cast("int")
        # By item and term: the weight with its repeats, the most it can add, the number of salts.
        weighed = asked.join(known, "term").select("item_id", "term", "df", (weight * F.col("qtf")).alias("w"), "most", salts.alias("salts")).where("w > 0").withColumn("most", F.col("w") * F.col("most"))
        # Postings ahead of a term among its item's rarer ones; what it and all terms of smaller bounds can add together.
        rarer = Window.partitionBy("item_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        smaller = Window.partitionBy("item_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
        weighed = scratch.save(weighed.withColumn("ahead", F.coalesce(F.sum("df").over(rarer), F.lit(0))).withColumn("upto", F.sum("most").over(smaller)))

        salted = known.select("term", salts.alias("salts"))
        posts = matches(forward.where("doc_id is not null")).join(salted, "term").select("term", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"), "row", "doc_id", F.col("part").cast("int").alias("part"))
        name = f"postings_{uuid.uuid4().hex}"
        posts = self._bucketed(posts, scratch, name)

        def summed(terms: DataFrame) -> DataFrame:
            """The items' terms joined with their postings, each match scored, summed by item and document."""
            spread = terms.select("item_id", "term", "w", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
            return posts.join(spread, ["term", "salt"]).groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("score"))

        def full(pairs: DataFrame, terms: DataFrame, *more: str) -> DataFrame:
            """What the terms add to documents ``item_id, row``, from the documents themselves; 0 if nothing."""
            held = matches(forward.join(pairs.select("row").distinct(), "row", "left_semi")).drop("doc_id")
            added = pairs.select("item_id", "row").join(held, "row").join(terms.select("item_id", "term", "w"), ["item_id", "term"])
            return added.groupBy("item_id", "row").agg(F.sum(F.col("w") * F.col("part")).alias("more"))

        best = lambda order: F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
        # First by the rarest terms: the k-th full score of the documents found is a threshold that k documents reach.
        tried = scratch.save(summed(weighed.where(F.col("ahead") < self.seeds)).withColumn("nth", best([F.desc("score"), "row"])).where(F.col("nth") <= self.tried).select("item_id", "row"))
        floors = full(tried, weighed).withColumn("nth", best([F.desc("more")])).where(F.col("nth") == self.k).select("item_id", F.col("more").alias("least"))
        floors = scratch.save(floors)
        # Terms that can't reach the threshold together come last: they join no postings.
        told = scratch.save(weighed.join(floors, "item_id", "left").withColumn("least", F.coalesce("least", F.lit(0))).withColumn("late", F.col("upto") < F.col("least")))
        rest = told.groupBy("item_id").agg(F.max("least").alias("least"), F.coalesce(F.sum(F.when(F.col("late"), F.col("most"))), F.lit(0)).alias("rest"))
        early = summed(told.where("not late")).join(rest, "item_id").where(F.col("score") + F.col("rest") >= F.col("least"))
        early = scratch.save(early.select("item_id", "row", "doc_id", "score"))
        late = full(early, told.where("late"))
        scores = early.join(late, ["item_id", "row"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0)))
        ranked = scores.withColumn("rank", best([F.desc("score"), "doc_id", "row"])).where((F.col("rank") <= self.k) & (F.col("score") > 0))
        out = scratch.save(ranked.select("item_id", "rank", "doc_id", "score"))
        scratch.keep(out)
        docs.sparkSession.sql(f"DROP TABLE {name}")
        scratch.delete(f"{scratch.root}/{name}")
        return out
