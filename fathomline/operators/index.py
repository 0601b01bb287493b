"""The index: a row for each chunk with its terms, and their statistics, written once and read by every search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import tokens
from fathomline.sources.tables import PLACE, Tables, in_blocks

#: The most terms whose weights are broadcast when norms are computed; those of the rarer ones are joined.
FREQUENT = 1 << 18


def words() -> Column:
    """All tokens of text and section title."""
    return tokens(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("section", F.lit(""))))


def postings(chunks: DataFrame) -> DataFrame:
    """``id, tok, tf`` over text and section title."""
    return chunks.select("id", F.explode(words()).alias("tok")).groupBy("id", "tok").agg(F.count("*").alias("tf"))


def doc_freq(posts: DataFrame) -> DataFrame:
    return posts.groupBy("tok").agg(F.count("*").alias("df"))


def doc_lengths(chunks: DataFrame) -> DataFrame:
    """``id, dl`` of every chunk, also of one without tokens."""
    return chunks.select("id", F.size(words()).cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: ``n, avgdl``."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf_stats(freq: DataFrame, stats: DataFrame) -> DataFrame:
    """``tok, df, idf_bm25, idf_tfidf``. Frequencies are those of the whole corpus, whatever a search filters."""
    n, df = F.col("n"), F.col("df")
    return freq.crossJoin(F.broadcast(stats.select("n"))).select(  # one row
        "tok", "df", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf_bm25"), (F.log(n / df) + 1).alias("idf_tfidf")
    )


def flat(batch: pa.RecordBatch, column: str) -> tuple[pa.Array, np.ndarray]:
    """The elements of all lists of a column, and the row of each."""
    lists = batch.column(column)
    return lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))


def listed(values: pa.Array, owner: np.ndarray, rows: int) -> pa.Array:
    """Elements put into the lists of their rows; owners ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), values)


def count_terms(rows: DataFrame, column: str = "words") -> DataFrame:
    """The rows with ``dl, toks, tfs`` in place of the array of words: its size, its distinct words in order, and how often each comes."""
    kept = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, owner = flat(batch, column)
            coded = said.dictionary_encode()
            names = coded.dictionary
            by_name = np.asarray(pc.sort_indices(names))
            place = np.empty(len(names), np.int64)
            place[by_name] = np.arange(len(names))
            width = max(1, len(names))
            key, tf = np.unique(owner * width + place[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
            toks = names.take(pa.array(by_name[key % width]))
            own = [batch.column(c) for c in kept]
            own += [pa.array(np.bincount(owner, minlength=batch.num_rows)), listed(toks, key // width, batch.num_rows), listed(pa.array(tf.astype(np.int32)), key // width, batch.num_rows)]
            yield pa.RecordBatch.from_arrays(own, names=[*kept, "dl", "toks", "tfs"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[F.col(f"`{c}`") for c in kept]).schema.fields)
    return rows.mapInArrow(run, f"{fields}, dl bigint, toks array<string>, tfs array<int>")


def term_freq(terms: DataFrame) -> DataFrame:
    """``tok, df`` from rows with ``toks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pc.value_counts(batch.column(0).flatten())
            yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["tok", "df"])

    return terms.select("toks").mapInArrow(run, "tok string, df bigint").groupBy("tok").agg(F.sum("df").alias("df"))


def norms(terms: DataFrame, idf: DataFrame, tables: Tables) -> DataFrame:
    """PLACE and ``norm`` of rows with ``toks, tfs``, written.

    The weights of the most frequent terms are broadcast, FREQUENT at most, so
    that nearly all postings stay where they are; only those of rarer terms
    are joined with their weights.
    """
    spark = terms.sparkSession
    # Terms by the power of two of their frequency: at most 64 rows.
    sizes = sorted(idf.groupBy(F.floor(F.log2("df")).alias("power")).agg(F.count("*").alias("n")).collect(), reverse=True)
    least, held = 1 << 62, 0
    for power, n in sizes:
        held += n
        if held > FREQUENT:
            break
        least = 1 << power
    common = idf.where(F.col("df") >= least).select("tok", "idf_tfidf").toArrow().combine_chunks()  # FREQUENT rows at most
    sent = spark.sparkContext.broadcast((pa.array(common.column(0).to_pylist(), pa.string()), common.column(1).to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = sent.value
        for batch in batches:
            said, owner = flat(batch, "toks")
            tf, rows = batch.column("tfs").flatten().to_numpy(zero_copy_only=False), batch.num_rows
            code = pc.fill_null(pc.index_in(said, value_set=known), -1).to_numpy(zero_copy_only=False)
            here, rare = np.flatnonzero(code >= 0), np.flatnonzero(code < 0)
            weight = tf[here] * weights[code[here]]
            square = np.asarray(np.bincount(owner[here], weight * weight, rows), float)  # of nothing, it counts in integers
            yield pa.RecordBatch.from_arrays([batch.column(PLACE), pa.array(square), listed(said.take(pa.array(rare)), owner[rare], rows), listed(pa.array(tf[rare]), owner[rare], rows)], names=[PLACE, "square", "toks", "tfs"])

    parts = tables.write(terms.select(PLACE, "toks", "tfs").mapInArrow(run, f"{PLACE} bigint, square double, toks array<string>, tfs array<int>"), "squares")
    weight = F.col("t.tfs") * F.col("idf_tfidf")
    rare = parts.select(PLACE, F.explode(F.arrays_zip("toks", "tfs")).alias("t")).join(idf, F.col("t.toks") == F.col("tok")).groupBy(PLACE).agg(F.sum(weight * weight).alias("more"))
    found = tables.write(parts.select(PLACE, "square").join(rare, PLACE, "left").select(PLACE, F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0))).alias("norm")), "norms")
    tables.drop(parts)
    return found


@dataclass(frozen=True)
class Index:
    """The written tables that every search reads.

    ``terms`` has a row for each chunk: ``id, order, course, kind, dl, norm``,
    and in ``toks, tfs`` its distinct terms and how often each comes. All that a
    chunk's scores need is in its row, so a search never moves a posting.
    """

    tables: Tables
    chunks: DataFrame
    terms: DataFrame
    stats: DataFrame
    idf: DataFrame

    @classmethod
    def build(cls, chunks: DataFrame) -> Index:
        """Tokenises the chunks, counts and writes. Chunks that are a written table already aren't written again."""
        tables = Tables(chunks.sparkSession, "index")
        chunks = chunks if hasattr(chunks, "_table_path") else tables.write(chunks, "chunks")
        said = chunks.select("id", F.col("order").cast("long").alias("order"), "course", "kind", words().alias("words"))
        counted = tables.write(count_terms(said).withColumn(PLACE, F.monotonically_increasing_id()), "counts")
        stats = tables.write(corpus_stats(counted), "stats")
        idf = tables.write(idf_stats(term_freq(counted), stats), "idf")
        terms = tables.write_all(in_blocks(counted, norms(counted, idf, tables)), "terms").drop(PLACE)
        tables.drop(counted)
        return cls(tables, chunks, terms, stats, idf)
