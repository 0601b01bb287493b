"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

# White space in Python's and Unicode's sense, as one trim set.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


def tokens(text: str) -> str:
    return (
        f"list_concat(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: length(t) >= 2), "
        f"flatten(list_transform(regexp_extract_all(lower({text}), '[一-鿿]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] "
        f"ELSE list_transform(range(1, length(r)), lambda i: substr(r, CAST(i AS INT), 2)) END)))"
    )


CHUNKS = f"""
files AS (SELECT 'course/' || source || '/' || doc_id || '.txt' AS rel, source AS course, CAST(doc_id AS VARCHAR) AS section, text FROM documents),
cut AS (SELECT rel, course, section, unnest(CASE WHEN length(text) <= 1200 THEN [0] ELSE range(0, length(text), 1080) END) AS pos, text FROM files),
pieces AS (SELECT rel, course, section, pos, trim(substr(text, CAST(pos + 1 AS INT), 1200), {_WS}) AS text FROM cut),
numbered AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY pos) AS ordinal FROM pieces WHERE length(text) >= 40),
chunks AS MATERIALIZED (SELECT substr(md5(rel || '|' || ordinal), 1, 12) AS id, rel, ordinal, course, 'course' AS kind, 'raw' AS layer, CAST(NULL AS VARCHAR) AS series, section,
  row_number() OVER (ORDER BY string_split(rel, '/'), ordinal) AS "order", text FROM numbered)"""

INDEX = f"""{CHUNKS},
words AS (SELECT id, unnest({tokens("text || ' ' || section")}) AS tok FROM chunks),
postings AS MATERIALIZED (SELECT id, tok, count(*) AS tf FROM words GROUP BY ALL),
lengths AS MATERIALIZED (SELECT id, len({tokens("text || ' ' || section")}) AS dl FROM chunks),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
idf AS MATERIALIZED (SELECT tok, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf_bm25, ln(CAST(n AS DOUBLE) / df) + 1 AS idf_tfidf FROM (SELECT tok, count(*) AS df FROM postings GROUP BY tok), stats),
norms AS MATERIALIZED (SELECT id, sqrt(sum((tf * idf_tfidf) * (tf * idf_tfidf))) AS norm FROM postings JOIN idf USING (tok) GROUP BY id)"""


def lexical(queries: str, where: str = "TRUE", k: int = 8) -> str:
    """CTEs up to ``hits`` for ``queries``, a select of qid and q."""
    return f"""{INDEX},
queries AS ({queries}),
terms AS MATERIALIZED (SELECT qid, tok, count(*) AS qtf FROM (SELECT qid, unnest({tokens("q")}) AS tok FROM queries) GROUP BY ALL),
about AS (SELECT qid, max(size) AS size, sqrt(sum(qtf * idf_tfidf * qtf * idf_tfidf)) AS qn FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS size FROM terms) JOIN idf USING (tok) GROUP BY qid),
scored AS MATERIALIZED (SELECT qid, id, sum(qtf * idf_bm25 * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25, sum(qtf * idf_tfidf * tf * idf_tfidf) AS dot, count(*) AS met
  FROM postings JOIN idf USING (tok) JOIN terms USING (tok) JOIN lengths USING (id) JOIN chunks USING (id), stats WHERE {where} GROUP BY qid, id),
both_scores AS MATERIALIZED (SELECT qid, id, "order" AS ord, bm25, dot / (norm * qn) AS tfidf, CAST(met AS DOUBLE) / size AS coverage FROM scored JOIN about USING (qid) JOIN norms USING (id) JOIN chunks USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, ord) - 1 AS rb, row_number() OVER (PARTITION BY qid ORDER BY round(tfidf, 9) DESC, ord) - 1 AS rt FROM both_scores),
fused AS (SELECT *, 1.0::DOUBLE / (60 + rb) + 1.0::DOUBLE / (60 + rt) AS rrf FROM ranked),
hits AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, rb, ord) - 1 AS rank FROM fused) WHERE rank < {k})"""


BENCHMARK = "SELECT item_id AS qid, text AS q FROM benchmark"
STORE = "store AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS vec FROM embeddings)"
NORM = "CASE WHEN {n} = 0 THEN 1 ELSE {n} END"


def length(v: str) -> str:
    n = f"sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
    return NORM.format(n=n)


def dot(x: str, y: str) -> str:
    return f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: CAST({x}[i] AS DOUBLE) * CAST({y}[i] AS DOUBLE)))"


def rounded(v: str, by: str = "1") -> str:
    """All components of a vector, divided, at six decimals, as text."""
    return f"array_to_string(list_transform({v}, lambda x: format('{{:.6f}}', round(CAST(x AS DOUBLE) / {by}, 6) + 0.0)), ' ')"
