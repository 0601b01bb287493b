"""Table schemas and search settings."""

from __future__ import annotations

from dataclasses import dataclass

CHUNKS = "id string, course string, kind string, layer string, series string, section string, `order` bigint, text string"
VECTORS = "id string, vec array<float>"
GOLDEN = "q string, lang string, expect array<struct<kind:string,course:string,section_contains:string>>"

# Kinds of material and layers, as stored in chunk tables.
KINDS = ("course", "video", "book", "data")
LAYERS = ("raw", "synth")


@dataclass(frozen=True)
class SearchConfig:
    """Everything that tunes a search; operators read nothing from the environment."""

    # BM25 and rank-fusion constants, thresholds and pool sizes.
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    k: int = 8
    lex_min_cov: float = 0.0
    vec_min_cos: float = 0.0
    w_lex: float = 1.0
    w_vec: float = 1.0
    rerank: bool = False
    rerank_pool: int = 30
    pool: int | None = None
    sem_floor: float = 0.30
    lex_floor: float = 0.15
    supported_cov: float = 0.6

    @property
    def take(self) -> int:
        return max(self.k, self.rerank_pool) if self.rerank else self.k

    @property
    def recall_pool(self) -> int:
        return self.pool or max(self.take * 4, 20)
