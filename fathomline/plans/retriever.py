"""What answering and evaluation ask of a backend, and the two backends there are.

Calls take tables of questions or claims and return DataFrames, so a backend is
asked once for all of them. Whether vectors are used is always said: ``mode``
chooses, and only ``"auto"`` goes back to words, with a warning.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import replace
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators import catalog, hybrid, verify
from fathomline.operators.index import Index
from fathomline.operators.lexical import search_lexical
from fathomline.operators.vectors import align, missing, topk
from fathomline.functions.text import contains_folded
from fathomline.schema import SearchConfig

#: ``id, vec`` of ``id, text`` rows; a model goes here, by ``sources.files.embed`` for one.
Vectors = Callable[[DataFrame], DataFrame]


@runtime_checkable
class Retriever(Protocol):
    """``search`` returns ``qid, id, rank, coverage`` and scores; ``verify`` and ``scores`` take ``qid, claim, chunk_ids``."""

    def search(self, queries: DataFrame, course: str | None = None, kind: str | None = None, k: int = 8) -> DataFrame: ...

    def fetch_section(self, course: str, section: str) -> DataFrame: ...

    def outline(self, course: str) -> DataFrame: ...

    def list_courses(self) -> DataFrame: ...

    def verify(self, claims: DataFrame) -> DataFrame: ...


class LexicalRetriever:
    """Search and verification by words."""

    method = "lexical"

    def __init__(self, index: Index, config: SearchConfig | None = None, fallback: str | None = None):
        #: Why vectors aren't used although they were asked for.
        self.fallback = fallback
        self.index, self.config = index, config or SearchConfig()

    @property
    def floor(self) -> float:
        return self.config.lex_floor

    def search(self, queries: DataFrame, course: str | None = None, kind: str | None = None, k: int = 8) -> DataFrame:
        return search_lexical(self.index, queries, replace(self.config, k=k), course, kind)

    def fetch_section(self, course: str, section: str) -> DataFrame:
        return catalog.fetch_section(self.index.chunks, course, section)

    def outline(self, course: str) -> DataFrame:
        return catalog.outline(self.index.chunks, course)

    def list_courses(self) -> DataFrame:
        return catalog.list_courses(self.index.chunks)

    def verify(self, claims: DataFrame) -> DataFrame:
        return verify.verify_lexical(claims, self.index.chunks, self.config)

    def scores(self, claims: DataFrame) -> DataFrame:
        """``qid, score``, to be compared with ``floor``."""
        return self.verify(claims).select("qid", F.col("coverage").alias("score"))


class HybridRetriever(LexicalRetriever):
    """Search by words and vectors, verification by vectors. A chunk without a vector is an error."""

    method = "semantic"

    def __init__(self, index: Index, store: DataFrame, embed: Vectors, config: SearchConfig | None = None):
        super().__init__(index, config)
        self.embed = embed
        self.store = align(index.chunks.select("id", "course", "kind"), store)

    @property
    def floor(self) -> float:
        return self.config.sem_floor

    def search(self, queries: DataFrame, course: str | None = None, kind: str | None = None, k: int = 8) -> DataFrame:
        config = replace(self.config, k=k)
        store = self.store
        if course:
            store = store.where(contains_folded(F.col("course"), F.lit(course)))
        if kind:
            store = store.where(F.col("kind") == kind)
        asked = self.embed(queries.select(F.col("qid").alias("id"), F.col("q").alias("text"))).select(F.col("id").alias("qid"), "vec")
        hits = hybrid.search_hybrid(self.index, queries, topk(store, asked, config.recall_pool), config, course, kind)
        if not config.rerank:
            return hits.drop("tfidf")
        best = hybrid.rerank(hits, queries, self.index, k)
        return best.join(hits.drop("rank", "tfidf"), ["qid", "id"])

    def scores(self, claims: DataFrame) -> DataFrame:
        own = self.embed(claims.select(F.col("qid").alias("id"), F.col("claim").alias("text"))).select(F.col("id").alias("qid"), "vec")
        return verify.verify_semantic(claims, self.store.select("id", "vec"), own)


def judge(retriever: LexicalRetriever, claims: DataFrame) -> DataFrame:
    """``qid, verdict, score, method, floor, real, fake`` of claims against the chunks they cite."""
    cited = verify.citations(claims, retriever.index.chunks)
    found = verify.verdicts(cited, retriever.scores(claims), retriever.floor)
    return found.join(cited, "qid").select("qid", "verdict", "score", F.lit(retriever.method).alias("method"), F.lit(retriever.floor).alias("floor"), "real", "fake")


def _unusable(index: Index, store: DataFrame | None, embed: Vectors | None) -> str | None:
    """Why a hybrid search isn't possible; null if it is."""
    if store is None:
        return "there is no vector store"
    if embed is None:
        return "there is no embedder"
    if not missing(index.chunks.select("id"), store).isEmpty():
        return "some chunks have no vector"
    try:
        probe = embed(index.chunks.sparkSession.createDataFrame([("probe", "probe")], "id string, text string")).first()
    except Exception as error:  # whatever a model raises
        return f"the embedder fails: {str(error).splitlines()[0] if str(error) else type(error).__name__}"
    if probe is None or probe["vec"] is None:
        return "the embedder gives no vector"
    if not store.where(F.size("vec") != len(probe["vec"])).isEmpty():
        return f"the embedder's {len(probe['vec'])} dimensions aren't the store's"
    return None


def open_retriever(index: Index, store: DataFrame | None = None, embed: Vectors | None = None, config: SearchConfig | None = None, mode: str = "auto") -> LexicalRetriever:
    """The backend for a mode.

    ``"lexical"`` never looks at vectors; ``"hybrid"`` raises if they can't be
    used; ``"auto"`` takes words then, says so in a warning and keeps the reason
    in ``fallback``.
    """
    if mode not in ("auto", "hybrid", "lexical"):
        raise ValueError(f"no mode {mode!r}: auto, hybrid or lexical")
    if mode == "lexical":
        return LexicalRetriever(index, config)
    reason = _unusable(index, store, embed)
    if reason is None:
        return HybridRetriever(index, store, embed, config)
    if mode == "hybrid":
        raise ValueError(f"no hybrid search: {reason}")
    warnings.warn(f"searching by words only: {reason}", stacklevel=2)
    return LexicalRetriever(index, config, reason)
