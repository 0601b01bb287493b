"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import ChatFormatter
from .embedding_duplicates import EmbeddingDuplicates
from .nbest_pieces import NBestPieces
from .near_duplicates import NearDuplicates
from .neighbour_graph import NeighbourGraph
from .packing import BestFitPacker
from .quality import QualityClassifier
from .ranked_search import RankedSearch
from .secret_scan import SecretScanner
from .topk_search import TopKSearch
from .toxicity import ToxicityClassifier
from .url_filter import UrlFilter
from .vector_codes import VectorCodes

#: The rules of the url query, (verdict, host, path).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ChatFormatter().format(table(spark, sf_dir, "conversations"))


OP1_SQL = """
WITH turns AS (
  SELECT conv_id, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS segment, turn
  FROM conversations
), placed AS (
  SELECT conv_id, segment, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, segment) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
), prefixes AS (
  SELECT conv_id, pos, n, string_agg(segment, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM placed
), whole AS (
  SELECT min(conv_id) AS conv_id, n, prefix FROM prefixes WHERE pos = n GROUP BY n, prefix
)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, prefix AS text
FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.pos < p.n AND p.pos = w.n AND p.prefix = w.prefix)
"""


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates().find(table(spark, sf_dir, "documents"))


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NBestPieces(piece_bpe_path()).check(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BestFitPacker(byte_bpe_path()).pack(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SecretScanner().scan(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, quality = table(spark, sf_dir, "documents"), QualityClassifier()
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EmbeddingDuplicates().find(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return UrlFilter(URL_RULES).judge(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, toxicity = table(spark, sf_dir, "documents"), ToxicityClassifier()
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 is a query against all documents."""
    docs = table(spark, sf_dir, "documents")
    return TopKSearch().search(docs.where("doc_id % 20 = 0"), docs)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VectorCodes().encode(table(spark, sf_dir, "embeddings"))


def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after another: ``b<i>`` are the entries of round ``i``, ``a<i>`` the parts' nearest of them."""
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, p, x[(p * len(x) // {parts} + 1):((p + 1) * len(x) // {parts})] AS c FROM v, range({parts}) AS r(p))",
        f"b0 AS MATERIALIZED (SELECT p, e, c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v) USING (vec_id) WHERE e < {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT vec_id, p, any_value(p.c) AS c, min(list_sum(list_transform(range(1, len(p.c) + 1), lambda i: (p.c[i] - b.c[i]) * (p.c[i] - b.c[i]))) * 256 + e) AS best FROM p JOIN b{i} b USING (p) GROUP BY vec_id, p)"
        )
        if i < rounds:
            # Floor division, whatever the sign.
            steps.append(
                f"s{i} AS (SELECT p, best % 256 AS e, j, sum(c[j + 1]) AS s, count(*) AS n FROM a{i}, range((SELECT max(len(c)) FROM p)) AS r(j) GROUP BY ALL), "
                f"m{i} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) AS BIGINT) // n ORDER BY j) AS c FROM s{i} GROUP BY p, e), "
                f"b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (p, e))"
            )
    return (
        f"WITH {', '.join(steps)}, coded AS (SELECT vec_id, string_agg(format('{{:02x}}', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id), "
        f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN v USING (vec_id), digest"
    )


def op12_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 is a query against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return NeighbourGraph().search(vectors.where("vec_id % 20 = 0"), vectors)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RankedSearch().search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH held AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), sized AS (SELECT doc_id, ts, len(ts) AS n FROM held WHERE len(ts) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS l FROM sized),
posts AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM sized) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weighed AS (SELECT item_id, term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN df USING (term), total),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l)))) AS BIGINT) AS score
  FROM weighed JOIN posts USING (term), total GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_sentencepiece_nbest": op3_sentencepiece_nbest,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_secret_scan": op5_secret_scan,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_embedding_near_dedup": op7_embedding_near_dedup,
        "op8_url_filter": op8_url_filter,
        "op9_toxicity": op9_toxicity,
        "op10_topk_search": op10_topk_search,
        "op11_vector_codes": op11_vector_codes,
        "op12_neighbour_graph": op12_neighbour_graph,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op11_vector_codes": _op11_sql(), "op13_ranked_search": OP13_SQL}
