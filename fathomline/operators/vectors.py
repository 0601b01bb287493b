"""The vector store as a table ``id, vec``, and brute-force search over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions.text import tokens
from fathomline.functions.vectors import half as at_half, normalize, truncate

from .lexical import DECIMALS

#: The most query vectors that are broadcast at once; more are searched block by block.
QUERY_BLOCK = 4096


def upsert(store: DataFrame, added: DataFrame) -> DataFrame:
    """The store with ``added(id, vec, pos)`` at unit length: ids it holds stay as they are, of repeated ids the first counts."""
    first = Window.partitionBy("id").orderBy("pos")
    fresh = added.withColumn("nth", F.row_number().over(first)).where("nth = 1").join(store.select("id"), "id", "left_anti")
    return store.select("id", "vec").unionByName(fresh.select("id", normalize(F.col("vec")).alias("vec")))


def missing(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """The chunks that have no vector yet."""
    return chunks.join(store.select("id"), "id", "left_anti")


def align(chunks: DataFrame, store: DataFrame, strict: bool = True) -> DataFrame:
    """Chunks with their vectors; if ``strict``, a chunk without one is an error."""
    joined = chunks.join(store.select("id", "vec"), "id", "left")
    if not strict:
        return joined
    return joined.withColumn("vec", F.when(F.col("vec").isNull(), F.raise_error(F.concat(F.lit("no vector for "), "id")).cast("array<float>")).otherwise(F.col("vec")))


def normalized(store: DataFrame) -> DataFrame:
    return store.select("id", normalize(F.col("vec")).alias("vec"))


def truncated(store: DataFrame, dim: int, half: bool = True) -> DataFrame:
    """The first ``dim`` components at unit length, as floats of half precision unless told otherwise."""
    cut = truncate(F.col("vec"), dim)
    return store.select("id", (at_half(cut) if half else cut).cast("array<float>").alias("vec"))


def topk(store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest vectors of each query ``qid, vec``: ``qid, id, rank, cos``.

    The store is not moved: its batches are multiplied with the block of query
    vectors, each partition keeps its ``k`` best over all its batches, and only
    those are shuffled, however many vectors are equally near. Queries come in blocks of QUERY_BLOCK so that what is broadcast
    has a fixed size.
    """
    asked = queries.where("vec is not null").select("qid", normalize(F.col("vec")).alias("vec"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for at in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == at).toPandas()  # about QUERY_BLOCK rows
        matrix = np.array(block["vec"].tolist(), np.float64).reshape(len(block), -1 if len(block) else 0)
        part = _block_topk(store, block["qid"].tolist(), matrix, k, dict(queries.dtypes)["qid"])
        found = part if found is None else found.union(part)
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("cos", DECIMALS)), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("qid", "id", "rank", "cos")


def hash_embed(rows: DataFrame, dim: int = 64) -> DataFrame:
    """``id, vec`` of ``id, text`` rows without a model: counts of tokens in hashed buckets, at unit length.

    A text without tokens counts its first eight characters as one. ``dim`` is a
    power of two up to 256, so that the last two hex digits of the MD5 decide
    the bucket. Ids are taken to be unique.
    """
    own = tokens(F.col("text"))
    words = rows.select("id", "text", own.alias("own")).select("id", F.explode(F.when(F.size("own") > 0, F.col("own")).otherwise(F.array(F.substring("text", 1, 8)))).alias("tok"))
    bucket = (F.conv(F.substring(F.md5("tok"), 31, 2), 16, 10).cast("int") % dim).alias("bucket")
    counts = words.select("id", bucket).groupBy("id", "bucket").agg(F.count("*").cast("double").alias("c"))
    maps = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "c"))).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    return maps.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)) / F.col("n")).alias("vec"))


def _block_topk(store: DataFrame, qids: list, matrix: np.ndarray, k: int, qid_type: str) -> DataFrame:
    sent = store.sparkSession.sparkContext.broadcast((qids, matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = sent.value
        best, pending = None, []
        # What the k-th best of each query is so far; a partition's later batches must reach it.
        least = np.full(len(names), -np.inf)
        for batch in batches:
            # Vectors that are null or of another length than the queries' have no cosine with them.
            batch = batch[[v is not None and len(v) == q.shape[1] for v in batch["vec"]]]
            ids, x = batch["id"].to_numpy(), np.array(batch["vec"].tolist(), np.float64)
            if not len(x) or not len(names):
                continue
            x /= np.where((n := np.linalg.norm(x, axis=1)) == 0, 1, n)[:, None]
            cos = q @ x.T
            edge = np.partition(cos, -min(k, len(x)), axis=1)[:, -min(k, len(x))]
            i, j = np.nonzero(cos >= np.maximum(edge, least)[:, None] - 1e-8)
            pending.append(pd.DataFrame({"at": i, "id": ids[j], "cos": cos[i, j]}))
            if sum(map(len, pending)) > 2 * k * len(names):
                best = _first_k([best, *pending], k)
                pending = []
                full = best.groupby("at")["cos"].agg(["min", "size"])
                full = full[full["size"] == k]
                least[full.index.to_numpy()] = full["min"].to_numpy()
        if best is not None or pending:
            best = _first_k([best, *pending], k)
            yield pd.DataFrame({"qid": [names[a] for a in best["at"]], "id": best["id"], "cos": best["cos"]})

    return store.select("id", "vec").mapInPandas(run, f"qid {qid_type}, id {dict(store.dtypes)['id']}, cos double")


def _first_k(parts: list, k: int) -> pd.DataFrame:
    """The first ``k`` rows of each query in the final order: by cosine at the decimals that count, then by id."""
    rows = pd.concat([p for p in parts if p is not None], ignore_index=True)
    rows = rows.assign(shown=rows["cos"].round(DECIMALS)).sort_values(["at", "shown", "id"], ascending=[True, False, True])
    return rows.groupby("at").head(k).drop(columns="shown")
