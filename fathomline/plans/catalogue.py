"""The registered queries: one for each operator, on the driver's tables or on inline fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import paths, text
from fathomline.operators import batch_fetch, catalog, evaluate, hybrid, live_index, messages, sections, sessions, verify
from fathomline.operators import vectors as store_ops
from fathomline.operators.index import Index, corpus_stats, doc_freq, doc_lengths, idf_stats, postings
from fathomline.operators.lexical import lexical_scores, search_lexical
from fathomline.schema import SearchConfig
from fathomline.sources.files import golden
from fathomline.sources.tables import Tables
from fathomline.sources.versions import VectorStore

from . import agent
from . import derived as D
from . import fixtures as X
from . import oracles as O
from .corpus import benchmark_queries, document_chunks, document_sections, embedding_store, index_of, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(vec: str) -> Column:
    """All components of a vector at six decimals, as text."""
    return F.array_join(F.transform(vec, lambda v: F.format_string("%.6f", F.round(v.cast("double"), 6) + F.lit(0.0))), " ").alias("vec")


def six(c: str | Column, name: str | None = None) -> Column:
    """Scores are compared at six decimals."""
    return F.round(c, 6).alias(name or c)


# ---- sources, sinks and ingestion ----

_FILES = X.values(X.FILES, "shown", "rel, text") + f", files AS (SELECT * FROM shown UNION ALL {D.FILES})"
_PATHS = X.values(X.PATHS, "shown", "rel") + f", p AS (SELECT * FROM shown UNION ALL {D.PATHS})"
_NL = "chr(10)"
_LINES = f"lined AS (SELECT rel, unnest(string_split(text, {_NL})) AS line, generate_subscripts(string_split(text, {_NL}), 1) AS n FROM files)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    return X.frame(spark, X.FILES, "rel string, text string").union(D.file_rows(spark, sf))


def all_paths(spark: SparkSession, sf: str) -> DataFrame:
    return X.frame(spark, X.PATHS, "rel string").union(D.path_rows(spark, sf))


@query(f"WITH {_PATHS} SELECT rel FROM p WHERE regexp_matches(lower(rel), '[^/.][^/]*\\.(md|txt|vtt|srt)$') AND NOT starts_with(list_last(string_split(rel, '/')), '_')")
def q_scan_filter_files(spark, sf):
    return all_paths(spark, sf).where(paths.is_source_file(F.col("rel")))


@query(f"WITH {O.CHUNKS} SELECT id, course, kind, layer, series, section, \"order\", text FROM chunks")
def q_scan_chunks(spark, sf):
    return document_chunks(spark, sf).select("id", "course", "kind", "layer", "series", "section", "order", "text")


@query(f"WITH {O.STORE} SELECT id, {O.rounded('vec')} AS vec FROM store")
def q_scan_vectors(spark, sf):
    return embedding_store(spark, sf).select("id", rounded("vec"))


_GOLDEN = X.values(X.GOLDEN, "shown", "line") + f", g AS (SELECT * FROM shown UNION ALL {D.GOLDEN})"


def golden_lines(spark: SparkSession, sf: str) -> DataFrame:
    return golden(X.frame(spark, X.GOLDEN, "value string").union(D.golden_rows(spark, sf)))


@query(
    f"WITH {_GOLDEN}, o AS (SELECT json_extract_string(line, '$.q') AS q, json_extract_string(line, '$.lang') AS lang, json_extract(line, '$.expect') AS e FROM g) "
    "SELECT q, lang, CASE WHEN json_type(e) = 'ARRAY' THEN json_array_length(e) ELSE 1 END::INT AS n_expect, coalesce(json_extract_string(e, '$.kind'), json_extract_string(e, '$[0].kind')) AS kind FROM o"
)
def q_scan_golden(spark, sf):
    return golden_lines(spark, sf).select("q", "lang", F.size("expect").alias("n_expect"), F.get("expect", F.lit(0))["kind"].alias("kind"))


@query(
    f"WITH {X.values(X.RESPONSES, 'shown', 'line')}, r AS (SELECT * FROM shown UNION ALL {D.RESPONSES}), o AS (SELECT json_extract_string(line, '$.custom_id') AS id, CAST(json_extract(line, '$.response.body.data[0].embedding') AS DOUBLE[]) AS vec FROM r "
    "WHERE line <> '' AND json_extract_string(line, '$.error') IS NULL AND json_extract_string(line, '$.response.status_code') = '200') SELECT id, CAST(len(vec) AS INT) AS dim, round(list_sum(vec), 6) AS total FROM o"
)
def q_parse_batch_output(spark, sf):
    found = messages.parse_responses(X.frame(spark, X.RESPONSES, "value string").union(D.response_rows(spark, sf)))
    return found.select("id", F.size("vec").alias("dim"), six(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v), "total"))


_PDF = X.values(X.PDF_PAGES, "shown", "pdf, page, t") + f", p AS (SELECT pdf, page, trim(coalesce(t, ''), {O._WS}) AS t FROM (SELECT * FROM shown UNION ALL {D.PDF_PAGES}))"


def pdf_pages(spark: SparkSession, sf: str) -> DataFrame:
    return X.frame(spark, X.PDF_PAGES, "pdf string, page int, text string").union(D.pdf_rows(spark, sf))


@query(
    f"WITH {_PDF}, a AS (SELECT pdf, count(*) AS pages, count(*) FILTER (length(t) >= 10) AS text_pages, CAST(coalesce(sum(length(t)) FILTER (length(t) >= 10), 0) AS BIGINT) AS chars FROM p GROUP BY pdf) "
    "SELECT *, (CAST(text_pages AS DOUBLE) / pages < 0.6 OR chars < 500) AS needs_ocr FROM a"
)
def q_pdf_ocr_decision(spark, sf):
    return messages.pdf_decision(pdf_pages(spark, sf))


@query(f"WITH {_PDF} SELECT pdf, coalesce(string_agg('[p.' || page || ']' || {_NL} || t, {_NL} || {_NL} ORDER BY page) FILTER (length(t) > 0), '') AS text FROM p GROUP BY pdf")
def q_pdf_page_join(spark, sf):
    return messages.join_pages(pdf_pages(spark, sf))


_BUCKET = "(('0x' || substr(md5(t), 31, 2))::INT % 64)"


@query(
    f"WITH d AS (SELECT doc_id, {O.tokens('text')} AS ts, text FROM documents), t AS (SELECT doc_id, unnest(CASE WHEN len(ts) > 0 THEN ts ELSE [substr(text, 1, 8)] END) AS t FROM d), "
    f"c AS (SELECT doc_id, {_BUCKET} AS bucket, count(*) AS c FROM t GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM c GROUP BY doc_id) "
    "SELECT doc_id, bucket, round(c / n, 6) AS weight FROM c JOIN n USING (doc_id)"
)
def q_hash_embed(spark, sf):
    docs = table(spark, sf, "documents")
    made = store_ops.hash_embed(docs.select(F.col("doc_id").alias("id"), "text"), 64)
    return made.select(F.col("id").alias("doc_id"), F.posexplode("vec").alias("bucket", "w")).where("w > 0").select("doc_id", "bucket", six("w", "weight"))


@query(
    "WITH RECURSIVE s AS (SELECT source AS lane, doc_id AS pos, least(greatest(length(coalesce(text, '')), 1), 20000) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents), "
    "w AS (SELECT lane, pos, nth, 0 AS batch, size AS chars, 1 AS held FROM s WHERE nth = 1 UNION ALL SELECT s.lane, s.pos, s.nth, CASE WHEN w.chars + s.size > 20000 OR w.held >= 16 THEN w.batch + 1 ELSE w.batch END, "
    "CASE WHEN w.chars + s.size > 20000 OR w.held >= 16 THEN s.size ELSE w.chars + s.size END, CASE WHEN w.chars + s.size > 20000 OR w.held >= 16 THEN 1 ELSE w.held + 1 END FROM w JOIN s ON s.lane = w.lane AND s.nth = w.nth + 1) "
    "SELECT lane, pos, CAST(batch AS INT) AS batch FROM w"
)
def q_subbatch_pack(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("lane"), F.col("doc_id").alias("pos"), "text")
    return messages.pack_batches(docs, 20_000, 16)


_UPSERTS = (
    f"{O.STORE}, held AS (SELECT * FROM store WHERE CAST(id AS BIGINT) % 3 <> 0), "
    "added AS (SELECT id, vec, CAST(id AS BIGINT) AS pos FROM store UNION ALL SELECT id, list_reverse(vec), CAST(id AS BIGINT) + 1000000 FROM store)"
)


@query(
    f"WITH {_UPSERTS}, fresh AS (SELECT id, vec FROM added WHERE id NOT IN (SELECT id FROM held) QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1) "
    f"SELECT id, {O.rounded('vec')} AS vec FROM held UNION ALL SELECT id, {O.rounded('vec', O.length('vec'))} FROM fresh"
)
def q_vector_upsert(spark, sf):
    store = embedding_store(spark, sf)
    pos = F.col("id").cast("long")
    added = store.withColumn("pos", pos).union(store.select("id", F.reverse("vec").alias("vec"), (pos + 1_000_000).alias("pos")))
    held = store.where(pos % 3 != 0).select("id", F.transform("vec", lambda v: v.cast("double")).alias("vec"))
    return store_ops.upsert(held, added).select("id", rounded("vec"))


@query(f"WITH {O.CHUNKS} SELECT CAST(floor((\"order\" - 1) / 1000) AS BIGINT) AS shard, id AS custom_id, 'small' AS model, md5(text) AS input FROM chunks")
def q_batch_request_lines(spark, sf):
    lines = messages.request_lines(document_chunks(spark, sf), "small", per_file=1000)
    body = F.from_json("line", "custom_id string, method string, url string, body struct<model:string,input:string>")
    return lines.select("shard", "custom_id", body.alias("o")).select("shard", "custom_id", F.col("o.body.model").alias("model"), F.md5("o.body.input").alias("input"))


# ---- text functions ----

_STRINGS = X.values([(i, s) for i, s in enumerate(X.STRINGS)], "s", "k, t")


@query(f"WITH {_STRINGS} SELECT k, array_to_string({O.tokens('t')}, '|') AS toks FROM s UNION ALL SELECT doc_id + 100, array_to_string({O.tokens('text')}, '|') FROM documents")
def q_tokenize(spark, sf):
    rows = X.frame(spark, [(i, s) for i, s in enumerate(X.STRINGS)], "k long, t string").union(table(spark, sf, "documents").select(F.col("doc_id") + 100, "text"))
    return rows.select("k", F.array_join(text.tokens(F.col("t")), "|").alias("toks"))


@query(f"WITH {O.INDEX} SELECT id, tok, tf FROM postings")
def q_term_freq(spark, sf):
    return postings(document_chunks(spark, sf))


_HEADED = f"{_FILES}, {_LINES}, h AS (SELECT * FROM lined WHERE rel IN (SELECT rel FROM files WHERE regexp_matches(text, '^#{{1,6}}\\s+')))"


@query(
    f"WITH {_HEADED}, m AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+') AS head, sum(CAST(regexp_matches(line, '^#{{1,6}}\\s+') AS INT)) OVER (PARTITION BY rel ORDER BY n) AS nth FROM h), "
    f"b AS (SELECT rel, nth, max(CASE WHEN head THEN trim(regexp_extract(line, '^#{{1,6}}\\s+(.*)', 1), {O._WS}) END) AS title, trim(coalesce(string_agg(line, {_NL} ORDER BY n) FILTER (NOT head), ''), {O._WS}) AS body FROM m GROUP BY rel, nth) "
    "SELECT rel, CAST(nth AS BIGINT) AS nth, title, body FROM b WHERE length(body) > 0"
)
def q_heading_sections(spark, sf):
    return sections.heading_sections(files(spark, sf)).select("rel", F.col("nth").cast("long").alias("nth"), "title", "body")


_PAGED = (
    f"{_FILES}, {_LINES}, marked AS (SELECT *, regexp_extract(line, '^[ \\t]*\\[p\\.(\\d+)\\][ \\t]*$', 1) AS pg FROM lined), counted AS (SELECT *, sum(CAST(pg <> '' AS INT)) OVER (PARTITION BY rel ORDER BY n) AS c, count(*) FILTER (pg <> '') OVER (PARTITION BY rel) AS marks, trim(line, {O._WS}) AS said FROM marked), "
    f"grouped AS (SELECT rel, CAST((c - 1) // 8 AS INT) AS nth, min(CAST(nullif(pg, '') AS INT)) AS a, max(CAST(nullif(pg, '') AS INT)) AS b, trim(string_agg(line, {_NL} ORDER BY n), {O._WS}) AS body, arg_min(substr(said, 1, 48), n) FILTER (length(said) BETWEEN 1 AND 60 AND regexp_matches(said, '{text.CHAPTER}')) AS hint FROM counted WHERE c >= 1 AND marks >= 2 GROUP BY ALL)"
)


@query(f"WITH {_PAGED} SELECT rel, nth, 'p.' || a || CASE WHEN a <> b THEN '-' || b ELSE '' END || coalesce(' · ' || hint, '') AS title, body FROM grouped WHERE length(body) >= 40")
def q_book_page_sections(spark, sf):
    return sections.page_sections(files(spark, sf))


_HINTS = [(1, "intro\n  Chapter 12 The End \nbody"), (2, "x\n第3章 开端\n"), (3, "part iv of it"), (4, "see Chapter 3 there"), (5, ""), (6, "Part Two\nChapter 9"), (7, "Chapter 1 " + "of a long line " * 5)]


@query(
    f"WITH {X.values(_HINTS, 'shown', 'k, t')}, h AS (SELECT * FROM shown UNION ALL {D.TITLED}), l AS (SELECT k, trim(unnest(string_split(t, {_NL})), {O._WS}) AS s, generate_subscripts(string_split(t, {_NL}), 1) AS n FROM h) "
    f"SELECT k, arg_min(substr(s, 1, 48), n) FILTER (length(s) BETWEEN 1 AND 60 AND regexp_matches(s, '{text.CHAPTER}')) AS hint FROM l GROUP BY k"
)
def q_chapter_hint(spark, sf):
    return X.frame(spark, _HINTS, "k long, t string").union(D.titled_rows(spark, sf)).select("k", text.chapter_hint(F.col("t")).alias("hint"))


@query(
    f"WITH {_FILES}, {_LINES}, s AS (SELECT rel, n, trim(line, {O._WS}) AS l FROM lined WHERE rel LIKE '%.vtt'), k AS (SELECT rel, n, regexp_replace(l, '<[^>]+>', '', 'g') AS l FROM s WHERE l <> '' AND l <> 'WEBVTT' AND NOT regexp_matches(l, '^\\d{{2}}:\\d{{2}}:\\d{{2}}[.,]\\d{{3}}\\s*-->') AND NOT regexp_matches(l, '^\\d+\\s*$')), "
    f"d AS (SELECT *, lag(l) OVER (PARTITION BY rel ORDER BY n) AS b FROM k), j AS (SELECT rel, string_agg(l, {_NL} ORDER BY n) AS text FROM d WHERE b IS NULL OR b <> l GROUP BY rel) SELECT rel, coalesce(j.text, '') AS text FROM files LEFT JOIN j USING (rel) WHERE rel LIKE '%.vtt'"
)
def q_subtitle_clean(spark, sf):
    return sections.clean_subtitles(files(spark, sf).where("rel like '%.vtt'"))


@query("WITH c AS (SELECT doc_id, unnest(CASE WHEN length(text) <= 1200 THEN [0] ELSE range(0, length(text), 1080) END) AS p, text FROM documents) SELECT doc_id, CAST(p // 1080 AS INT) AS piece, substr(text, CAST(p + 1 AS INT), 1200) AS body FROM c")
def q_char_window(spark, sf):
    return sections.char_window(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "piece", "body")


@query(
    f"WITH {_PATHS}, s AS (SELECT rel, string_split(rel, '/') AS x FROM p), t AS (SELECT rel, x, len(x) AS n, x[1] AS top, lower(x[1]) IN ('course', 'book', 'video', 'data') AS bucket FROM s) "
    "SELECT rel, CASE WHEN bucket THEN CASE WHEN n >= 3 THEN lower(top) END WHEN n >= 2 THEN coalesce(nullif(lower(regexp_extract(top, '^(Video|Book|Data)_', 1)), ''), 'course') END AS kind, "
    "CASE WHEN bucket THEN CASE WHEN n >= 3 THEN replace(x[n - 1], '_', ' ') END WHEN n >= 2 THEN replace(regexp_replace(top, '^(Video|Book|Data)_', ''), '_', ' ') END AS course, "
    "CASE WHEN bucket AND n > 3 THEN replace(array_to_string(x[2:n - 2], '/'), '_', ' ') END AS series FROM t"
)
def q_classify_path(spark, sf):
    return all_paths(spark, sf).withColumn("c", paths.classify(F.col("rel"))).select("rel", "c.kind", "c.course", "c.series")


@query(f"WITH {O.CHUNKS} SELECT rel, CAST(ordinal AS INT) AS ordinal, id FROM chunks")
def q_chunk_id(spark, sf):
    return sections.chunks(document_sections(spark, sf)).select("rel", "ordinal", "id")


@query("WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 700 THEN substr(t, 1, 700) || '…' ELSE t END AS shown FROM c")
def q_clip_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clip(F.col("text"), 700).alias("shown"))


_BREAK = "chr(10) || chr(10)"
_FITS = f"length(CASE WHEN w.buf = '' THEN p.para ELSE w.buf || {_BREAK} || p.para END) <= 1500"
_FULL = "CAST(greatest(ceil(length(p.para) / 1500.0) - 1, 0) AS INT)"


@query(
    f"WITH RECURSIVE d AS (SELECT doc_id, replace(text, chr(10), {_BREAK}) AS t FROM documents), "
    f"p AS MATERIALIZED (SELECT doc_id, unnest(string_split(t, {_BREAK})) AS para, generate_subscripts(string_split(t, {_BREAK}), 1) AS n FROM d WHERE length(t) > 1500), "
    f"w AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, [''] AS outs, '' AS buf FROM p UNION ALL SELECT p.doc_id, p.n, CASE WHEN {_FITS} THEN [] ELSE list_concat([w.buf], list_transform(range(0, {_FULL}), lambda i: substr(p.para, CAST(i * 1500 + 1 AS INT), 1500))) END, "
    f"CASE WHEN {_FITS} THEN CASE WHEN w.buf = '' THEN p.para ELSE w.buf || {_BREAK} || p.para END ELSE substr(p.para, {_FULL} * 1500 + 1, 1500) END FROM w JOIN p ON p.doc_id = w.doc_id AND p.n = w.n + 1), "
    "pieces AS (SELECT doc_id, n, unnest(outs) AS body, generate_subscripts(outs, 1) AS i FROM w UNION ALL SELECT doc_id, max(n) + 1, arg_max(buf, n), 1 FROM w GROUP BY doc_id) "
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, i) - 1 AS INT) AS part, body FROM pieces WHERE body <> '' UNION ALL SELECT doc_id, 0, t FROM d WHERE length(t) <= 1500"
)
def q_split_message(spark, sf):
    parts = table(spark, sf, "documents").select("doc_id", F.posexplode(messages.split_message(F.regexp_replace("text", "\n", "\n\n"))).alias("part", "body"))
    return parts.select("doc_id", "part", "body")


@query(f"WITH {O.CHUNKS} SELECT rel, CAST(ordinal AS INT) AS ordinal, \"order\" FROM chunks")
def q_assign_order(spark, sf):
    return sections.assign_order(sections.chunks(document_sections(spark, sf)).select("rel", "ordinal")).select("rel", "ordinal", "order")


@query()
def q_ingest_files(spark, sf):
    """The whole route from files to ordered chunks."""
    kept = files(spark, sf).where(paths.is_source_file(F.col("rel")))
    return sections.assign_order(sections.chunks(sections.sections(kept))).select("id", "rel", "course", "kind", "series", "section", "order", "text")


# ---- vectors ----


@query(f"WITH {O.STORE} SELECT id, {O.rounded('vec', O.length('vec'))} AS vec FROM store")
def q_vector_normalize(spark, sf):
    rows = store_ops.normalized(embedding_store(spark, sf))
    return rows.select("id", rounded("vec"))


_CUT = f"list_transform(vec[1:16], lambda x: CAST(x AS DOUBLE) / {O.length('vec[1:16]')})"
_STEP = "pow(2.0, greatest(floor(log2(abs(x))), -14) - 10)"


@query(f"WITH {O.STORE}, c AS (SELECT id, {_CUT} AS vec FROM store), h AS (SELECT id, list_transform(vec, lambda x: CASE WHEN x = 0 THEN x ELSE round_even(x / {_STEP}, 0) * {_STEP} END) AS vec FROM c) SELECT id, {O.rounded('vec')} AS vec FROM h")
def q_vector_truncate(spark, sf):
    return store_ops.truncated(embedding_store(spark, sf), 16).select("id", rounded("vec"))


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_store(spark, sf).where(F.col("id").cast("long") % 20 == 0).select(F.col("id").cast("long").alias("qid"), "vec")


_UNIT = f"{O.STORE}, unit AS (SELECT id, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v, {O.length('vec')} AS l FROM store)"
_VECTOR = (
    f"{_UNIT}, cosines AS (SELECT CAST(q.id AS BIGINT) AS qid, d.id, list_dot_product(q.v, d.v) / (q.l * d.l) AS cos FROM unit q, unit d WHERE CAST(q.id AS BIGINT) % 20 = 0), "
    "vhits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 9) DESC, id) - 1 AS rank FROM cosines)"
)


@query(f"WITH {_VECTOR} SELECT qid, id, rank, round(cos, 6) AS cos FROM vhits WHERE rank < 10")
def q_vector_topk(spark, sf):
    return store_ops.topk(embedding_store(spark, sf), _vector_queries(spark, sf), 10).select("qid", "id", F.col("rank").cast("long").alias("rank"), six("cos"))


# The store that covers the chunks: the embeddings dealt round over the corpus order, and a gap at every seventh.
_CHUNK_VECTORS = f"{O.CHUNKS}, total AS (SELECT count(*) AS n FROM embeddings), cvec AS (SELECT c.id, e.embedding AS vec FROM chunks c, total t, embeddings e WHERE e.vec_id = c.\"order\" % t.n)"


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vecs = table(spark, sf, "embeddings")
    n = vecs.agg(F.count("*").alias("n"))
    placed = index_of(spark, sf).chunks.select("id", "order").crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("order") % F.col("n"))  # one row
    return placed.join(vecs.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("id", "order", "vec")


@query(f"WITH {_CHUNK_VECTORS} SELECT id, {O.rounded('vec')} AS vec FROM cvec")
def q_align_vectors(spark, sf):
    return store_ops.align(index_of(spark, sf).chunks.select("id"), chunk_vectors(spark, sf).drop("order")).select("id", rounded("vec"))


@query(f"WITH {O.CHUNKS} SELECT id FROM chunks WHERE \"order\" % 7 = 0")
def q_missing_vectors(spark, sf):
    return store_ops.missing(index_of(spark, sf).chunks, chunk_vectors(spark, sf).where(F.col("order") % 7 != 0)).select("id")


@query(f"WITH {O.CHUNKS} SELECT id FROM chunks WHERE course = 'src3' EXCEPT SELECT id FROM chunks WHERE \"order\" % 2 = 0")
def q_incremental_ids(spark, sf):
    rows = index_of(spark, sf).chunks
    return rows.where("course = 'src3'").select("id").subtract(rows.where(F.col("order") % 2 == 0).select("id"))


# ---- index and lexical search ----


@query(f"WITH {O.INDEX} SELECT tok, df FROM idf")
def q_doc_freq(spark, sf):
    return doc_freq(postings(document_chunks(spark, sf)))


@query(f"WITH {O.INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def q_corpus_stats(spark, sf):
    return corpus_stats(doc_lengths(document_chunks(spark, sf))).select("n", six("avgdl"))


@query(f"WITH {O.INDEX} SELECT tok, df, round(idf_bm25, 6) AS idf_bm25, round(idf_tfidf, 6) AS idf_tfidf FROM idf")
def q_idf_stats(spark, sf):
    rows = document_chunks(spark, sf)
    return idf_stats(doc_freq(postings(rows)), corpus_stats(doc_lengths(rows))).select("tok", "df", six("idf_bm25"), six("idf_tfidf"))


@query(f"WITH {O.INDEX} SELECT id, round(norm, 6) AS norm FROM norms")
def q_tfidf_norms(spark, sf):
    return index_of(spark, sf).terms.where("dl > 0").select("id", six("norm"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_scores(index_of(spark, sf), benchmark_queries(spark, sf))


@query(f"WITH {O.lexical(O.BENCHMARK)} SELECT qid, id, round(bm25, 6) AS bm25 FROM both_scores")
def q_search_bm25(spark, sf):
    return _scored(spark, sf).select("qid", "id", six("bm25"))


@query(f"WITH {O.lexical(O.BENCHMARK)} SELECT qid, id, round(tfidf, 6) AS tfidf FROM both_scores")
def q_search_tfidf(spark, sf):
    return _scored(spark, sf).select("qid", "id", six("tfidf"))


@query(f"WITH {O.lexical(O.BENCHMARK)} SELECT qid, id, round(coverage, 6) AS coverage FROM both_scores")
def q_coverage(spark, sf):
    return _scored(spark, sf).select("qid", "id", six("coverage"))


_HIT = "qid, id, rank, round(rrf, 6) AS rrf, round(bm25, 6) AS bm25, round(tfidf, 6) AS tfidf, round(coverage, 6) AS coverage"


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "id", F.col("rank").cast("long").alias("rank"), six("rrf"), six("bm25"), six("tfidf"), six("coverage"))


@query(f"WITH {O.lexical(O.BENCHMARK)} SELECT {_HIT} FROM hits")
def q_search_lexical(spark, sf):
    return _hits(search_lexical(index_of(spark, sf), benchmark_queries(spark, sf)))


@query(f"""WITH {O.lexical(O.BENCHMARK, "contains(lower(course), 'src1') AND kind = 'course'")} SELECT {_HIT} FROM hits""")
def q_search_filtered(spark, sf):
    return _hits(search_lexical(index_of(spark, sf), benchmark_queries(spark, sf), course="SRC1", kind="course"))


@query(f"WITH {O.CHUNKS} SELECT course, count(*) AS n FROM chunks GROUP BY course")
def q_list_courses(spark, sf):
    return catalog.list_courses(index_of(spark, sf).chunks)


@query(f"WITH {O.CHUNKS} SELECT section, min(\"order\") AS first FROM chunks WHERE contains(lower(course), 'src1') GROUP BY section")
def q_outline(spark, sf):
    return catalog.outline(index_of(spark, sf).chunks, "Src1")


@query(f"WITH {O.CHUNKS} SELECT id, course, section, \"order\", text, layer FROM chunks WHERE contains(lower(course), 'src') AND section = '7'")
def q_fetch_section(spark, sf):
    return catalog.fetch_section(index_of(spark, sf).chunks, "SRC", "7")


@query(f"WITH {O.CHUNKS} SELECT course, count(DISTINCT rel) AS files, count(*) AS chunks FROM chunks GROUP BY ROLLUP (course)")
def q_ingest_stats(spark, sf):
    return catalog.ingest_stats(index_of(spark, sf).chunks)


_WISHES = [(1, "SRC7"), (2, "src1"), (3, "rc1"), (4, "nothing")]


@query(
    f"WITH {O.CHUNKS}, c AS (SELECT course, count(*) AS n, min(\"order\") AS first FROM chunks GROUP BY course), {X.values(_WISHES, 'w', 'qid, q')}, "
    "m AS (SELECT qid, course, row_number() OVER (PARTITION BY qid ORDER BY lower(course) <> lower(q), n DESC, first) AS r FROM w JOIN c ON contains(lower(course), lower(q))) SELECT w.qid, course FROM w LEFT JOIN m ON w.qid = m.qid AND r = 1"
)
def q_course_match(spark, sf):
    courses = index_of(spark, sf).chunks.groupBy("course").agg(F.count("*").alias("n"), F.min("order").alias("first"))
    return catalog.course_match(X.frame(spark, _WISHES, "qid int, q string"), courses)


# ---- a corpus that changes ----

# The state before: every 97th document isn't there yet, every 89th has another beginning, every 103rd is there twice.
_BEFORE = (
    "(SELECT source, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 89 = 5 THEN 'an earlier wording, ' || text ELSE text END AS text FROM documents WHERE doc_id % 97 <> 3 "
    "UNION ALL SELECT source, doc_id || '-old', text FROM documents WHERE doc_id % 103 = 7)"
)


def _sections_before(spark: SparkSession, sf: str) -> DataFrame:
    found = document_sections(spark, sf)
    number = F.col("title").cast("long")
    edited = F.when(number % 89 == 5, F.concat(F.lit("an earlier wording, "), "body")).otherwise(F.col("body"))
    twice = found.where(number % 103 == 7).withColumn("rel", F.concat(F.lit("course/"), "course", F.lit("/"), "title", F.lit("-old.txt"))).withColumn("title", F.concat("title", F.lit("-old")))
    return found.where(number % 97 != 3).withColumn("body", edited).unionByName(twice)


@query(
    f"WITH now AS (WITH {O.CHUNKS} SELECT id, text FROM chunks), earlier AS (WITH {O.CHUNKS.replace('FROM documents', f'FROM {_BEFORE}')} SELECT id, text FROM chunks) "
    "SELECT coalesce(w.id, i.id) AS id, CASE WHEN w.id IS NULL THEN 'added' WHEN i.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM earlier w FULL JOIN now i ON w.id = i.id WHERE w.text IS DISTINCT FROM i.text"
)
def q_change_capture(spark, sf):
    state = lambda rows: rows.select("id", live_index.fingerprint().alias("print"))
    return live_index.changes(state(sections.chunks(_sections_before(spark, sf))), state(sections.chunks(document_sections(spark, sf))))


@query(f"WITH {O.lexical(O.BENCHMARK)} SELECT qid, id, rank, round(rrf, 6) AS rrf, round(bm25, 6) AS bm25, round(tfidf, 6) AS tfidf, round(coverage, 6) AS coverage FROM hits")
def q_index_update(spark, sf):
    """Searches an index of the state before that was brought up to date; the SQL builds anew."""
    tables = Tables(spark, "live")
    live = live_index.LiveIndex(spark, f"{tables.root}/index")
    before = sections.ordered_chunks(_sections_before(spark, sf))
    live.update(before)
    tables.drop(before)
    now = sections.ordered_chunks(document_sections(spark, sf))
    live.sync(now)
    tables.drop(now)
    hits = search_lexical(live.snapshot(), benchmark_queries(spark, sf))
    return hits.select("qid", "id", F.col("rank").cast("long").alias("rank"), six("rrf"), six("bm25"), six("tfidf"), six("coverage"))


@query(
    f"WITH {O.STORE}, later AS (SELECT id, list_reverse(vec) AS vec FROM store WHERE CAST(id AS BIGINT) % 5 = 0 OR CAST(id AS BIGINT) % 3 = 0), first AS (SELECT * FROM store WHERE CAST(id AS BIGINT) % 3 <> 0 AND CAST(id AS BIGINT) % 7 <> 0), "
    f"kept AS (SELECT * FROM first UNION ALL SELECT * FROM later WHERE id NOT IN (SELECT id FROM first)), measured AS (SELECT id, vec, {O.length('vec')} AS l FROM kept WHERE vec IS NOT NULL), unit AS (SELECT id, list_transform(vec, lambda x: CAST(CAST(x AS DOUBLE) / l AS FLOAT)) AS vec FROM measured) SELECT id, {O.rounded('vec')} AS vec FROM unit"
)
def q_vector_versions(spark, sf):
    """All vectors but every third go in, every seventh of them is taken out, then others come for ids that are there or not."""
    rows, number = embedding_store(spark, sf), F.col("id").cast("long")
    store = VectorStore(spark, f"{Tables(spark, 'live').root}/vectors")
    store.upsert(rows.where(number % 3 != 0), ("query", 0))
    store.remove(rows.where(number % 7 == 0), ("query", 1))
    later = rows.where((number % 5 == 0) | (number % 3 == 0)).withColumn("vec", F.reverse("vec"))
    store.upsert(later, ("query", 2))
    store.upsert(rows, ("query", 2))  # replayed: changes nothing
    return store.read().select("id", rounded("vec"))


# ---- hybrid search ----

_CVECTOR = (
    f"{_CHUNK_VECTORS.replace(O.CHUNKS + ', ', '')}, unit AS MATERIALIZED (SELECT id, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v, {O.length('vec')} AS l FROM cvec), "
    "qvec AS (SELECT item_id AS qid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, vec_id FROM benchmark JOIN embeddings ON vec_id = item_id), "
    f"qunit AS (SELECT qid, v, {O.length('v')} AS l FROM qvec), cosines AS MATERIALIZED (SELECT qid, d.id, list_dot_product(q.v, d.v) / (q.l * d.l) AS cos FROM qunit q, unit d), "
    "vall AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 9) DESC, id) - 1 AS rank FROM cosines), "
    # Ranks are made whole, then cut in a table of their own; greatest keeps the cut from moving into the window.
    "vcut AS MATERIALIZED (SELECT * FROM vall WHERE greatest(rank, 0) < 120)"
)


def _hybrid_sql(lex_min: float, vec_min: float, w_vec: float, k: int = 8, pool: int = 32) -> str:
    return (
        f"{O.lexical(O.BENCHMARK, k=pool)}, {_CVECTOR}, lx AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS place FROM hits WHERE round(coverage, 2) >= {lex_min}), "
        f"parts AS (SELECT qid, id, 1.0::DOUBLE / (60 + place) AS part, place AS lex, NULL AS vec, NULL AS cos FROM lx UNION ALL SELECT qid, id, {w_vec}::DOUBLE / (60 + rank), NULL, rank, cos FROM vcut WHERE rank < {pool} AND cos >= {vec_min}), "
        "summed AS (SELECT qid, id, sum(part) AS rrf, min(lex) AS lex, min(vec) AS vec, coalesce(max(cos), 0) AS cos FROM parts GROUP BY qid, id), "
        "fused_all AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, lex NULLS LAST, vec NULLS LAST) - 1 AS rank FROM summed), "
        f"fhits AS MATERIALIZED (SELECT * FROM fused_all WHERE greatest(rank, 0) < {k}), "
        "full_hits AS (SELECT f.qid, f.id, f.rank, f.rrf, f.cos, coalesce(b.coverage, 0) AS coverage FROM fhits f LEFT JOIN both_scores b USING (qid, id))"
    )


def _vector_ranking(spark: SparkSession, sf: str, pool: int) -> DataFrame:
    asked = table(spark, sf, "benchmark").join(table(spark, sf, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("qid"), F.col("embedding").alias("vec"))
    return store_ops.topk(chunk_vectors(spark, sf).select("id", "vec"), asked, pool)


def _hybrid(spark: SparkSession, sf: str, config: SearchConfig) -> tuple[Index, DataFrame]:
    index = index_of(spark, sf)
    return index, hybrid.search_hybrid(index, benchmark_queries(spark, sf), _vector_ranking(spark, sf, config.recall_pool), config)


_FUSED = "qid, id, rank, round(rrf, 6) AS rrf, round(cos, 6) AS cos, round(coverage, 6) AS coverage"


def _fused(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "id", F.col("rank").cast("long").alias("rank"), six("rrf"), six("cos"), six("coverage"))


@query(f"WITH {_hybrid_sql(0.0, 0.0, 1.0)} SELECT {_FUSED} FROM full_hits")
def q_hybrid_rrf(spark, sf):
    return _fused(_hybrid(spark, sf, SearchConfig())[1])


@query(f"WITH {_hybrid_sql(0.5, 0.2, 2.0)} SELECT {_FUSED} FROM full_hits")
def q_hybrid_thresholds(spark, sf):
    return _fused(_hybrid(spark, sf, SearchConfig(lex_min_cov=0.5, vec_min_cos=0.2, w_vec=2.0))[1])


@query(f"WITH {_hybrid_sql(0.0, 0.0, 1.0)} SELECT qid, rank, round(rrf, 6) AS rrf, round(cos, 6) AS cos, round(coverage, 6) AS coverage, kind, course, section FROM full_hits JOIN chunks USING (id)")
def q_score_diagnostics(spark, sf):
    index, hits = _hybrid(spark, sf, SearchConfig())
    shown = hybrid.diagnostics(hits, index.chunks)
    return shown.select("qid", F.col("rank").cast("long").alias("rank"), six("rrf"), six("cos"), six("coverage"), "kind", "course", "section")


@query(
    f"WITH {_hybrid_sql(0.0, 0.0, 1.0, k=30, pool=120)}, rr AS (SELECT f.qid, f.id, coalesce(b.tfidf, 0) AS rerank, row_number() OVER (PARTITION BY f.qid ORDER BY round(coalesce(b.tfidf, 0), 9) DESC, f.rank) - 1 AS rank "
    "FROM full_hits f LEFT JOIN both_scores b USING (qid, id)) SELECT qid, id, rank, round(rerank, 6) AS rerank FROM rr WHERE rank < 8"
)
def q_rerank_topk(spark, sf):
    config = SearchConfig(rerank=True)
    index, hits = _hybrid(spark, sf, config)
    top = hybrid.rerank(hits, benchmark_queries(spark, sf), index, config.k)
    return top.select("qid", "id", F.col("rank").cast("long").alias("rank"), six("rerank"))


# ---- verification ----

# Claims: the benchmark texts, each citing the chunks of its first three lexical hits and one id that doesn't exist.
_CLAIMS = f"{O.lexical(O.BENCHMARK, k=3)}, cited AS (SELECT qid, id FROM hits WHERE qid % 5 <> 0), claims AS (SELECT qid, q AS claim FROM queries)"
_LEXVERIFY = (
    f"{_CLAIMS}, own AS (SELECT DISTINCT qid, tok FROM terms), pool AS (SELECT DISTINCT qid, unnest({O.tokens('text')}) AS tok FROM cited JOIN chunks USING (id)), "
    "cov AS (SELECT c.qid, coalesce(count(p.tok) / nullif(CAST(count(o.tok) AS DOUBLE), 0), 0) AS coverage, coalesce(array_to_string(list_sort(list(o.tok) FILTER (p.tok IS NULL AND o.tok IS NOT NULL))[1:12], '|'), '') AS missing "
    "FROM claims c LEFT JOIN own o ON c.qid = o.qid LEFT JOIN pool p ON o.qid = p.qid AND o.tok = p.tok GROUP BY c.qid)"
)


def claims_of(spark: SparkSession, sf: str, index: Index) -> DataFrame:
    asked = benchmark_queries(spark, sf)
    hits = search_lexical(index, asked, k=3).where("qid % 5 <> 0").groupBy("qid").agg(F.collect_list("id").alias("ids"))
    ids = F.concat(F.coalesce("ids", F.array().cast("array<string>")), F.array(F.lit("deadbeef0000")))
    return asked.join(hits, "qid", "left").select("qid", F.col("q").alias("claim"), ids.alias("chunk_ids"))


@query(f"WITH {_LEXVERIFY} SELECT qid, coverage >= 0.6 AS supported, round(coverage, 6) AS coverage, missing FROM cov")
def q_verify_lexical(spark, sf):
    index = index_of(spark, sf)
    found = verify.verify_lexical(claims_of(spark, sf, index), index.chunks)
    return found.select("qid", "supported", six("coverage"), F.array_join("missing", "|").alias("missing"))


_SEMVERIFY = f"{_CLAIMS}, {_CVECTOR}, sem AS (SELECT c.qid, coalesce(max(s.cos), 0) AS score FROM claims c LEFT JOIN cited k ON c.qid = k.qid LEFT JOIN cosines s ON k.qid = s.qid AND k.id = s.id GROUP BY c.qid)"


def _semantic(spark: SparkSession, sf: str, claims: DataFrame) -> DataFrame:
    asked = table(spark, sf, "benchmark").join(table(spark, sf, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("qid"), F.col("embedding").alias("vec"))
    return verify.verify_semantic(claims, chunk_vectors(spark, sf), asked)


@query(f"WITH {_SEMVERIFY} SELECT qid, round(score, 6) AS score FROM sem")
def q_verify_semantic(spark, sf):
    return _semantic(spark, sf, claims_of(spark, sf, index_of(spark, sf))).select("qid", six("score"))


@query(f"WITH {_CLAIMS} SELECT c.qid, coalesce(array_to_string(list_sort(list(k.id) FILTER (k.id IS NOT NULL)), '|'), '') AS real, 'deadbeef0000' AS fake FROM claims c LEFT JOIN cited k USING (qid) GROUP BY c.qid")
def q_citation_real_fake(spark, sf):
    index = index_of(spark, sf)
    found = verify.citations(claims_of(spark, sf, index), index.chunks)
    return found.select("qid", F.array_join("real", "|").alias("real"), F.array_join("fake", "|").alias("fake"))


@query(f"WITH {_LEXVERIFY}, r AS (SELECT c.qid, count(k.id) AS n FROM claims c LEFT JOIN cited k USING (qid) GROUP BY c.qid) SELECT qid, CASE WHEN n = 0 THEN 'BLOCK' WHEN coverage >= 0.15 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS verdict, round(coverage, 6) AS score FROM cov JOIN r USING (qid)")
def q_verify_verdict(spark, sf):
    index = index_of(spark, sf)
    claims = claims_of(spark, sf, index)
    scores = verify.verify_lexical(claims, index.chunks).select("qid", F.col("coverage").alias("score"))
    return verify.verdicts(verify.citations(claims, index.chunks), scores, SearchConfig().lex_floor).select("qid", "verdict", six("score"))


@query(
    f"WITH {_SEMVERIFY}, v AS (SELECT c.qid, count(k.id) AS n FROM claims c LEFT JOIN cited k ON c.qid = k.qid AND c.qid % 3 <> 0 GROUP BY c.qid), "
    "z AS (SELECT qid, CASE WHEN qid % 11 = 0 THEN 'self' WHEN n = 0 THEN 'no_citation' WHEN score < 0.3 THEN 'low_support' END AS reason, score FROM v JOIN sem USING (qid)) SELECT qid, reason IS NOT NULL AS blocked, reason, round(score, 6) AS score FROM z"
)
def q_answer_veto(spark, sf):
    index = index_of(spark, sf)
    claims = claims_of(spark, sf, index)
    # What a session has seen: all real citations but those of every third question.
    seen = claims.where("qid % 3 <> 0").select("qid", F.explode("chunk_ids").alias("id")).where("id <> 'deadbeef0000'")
    answers = claims.withColumn("blocked", F.col("qid") % 11 == 0)
    return verify.answer_veto(answers, seen, _semantic(spark, sf, claims), SearchConfig().sem_floor).select("qid", "blocked", "reason", six("score"))


@query(
    f"WITH {O.lexical(O.BENCHMARK, k=12)}, f AS (SELECT qid, course, section, min(rank) AS pos FROM hits JOIN chunks USING (id) GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS nth FROM f) SELECT qid, nth, course, section FROM n WHERE nth <= 5"
)
def q_citation_dedup(spark, sf):
    index = index_of(spark, sf)
    hits = search_lexical(index, benchmark_queries(spark, sf), k=12).join(index.chunks.select("id", "course", "section"), "id")
    return verify.dedup_citations(hits.withColumnRenamed("rank", "pos")).select("qid", F.col("nth").cast("long").alias("nth"), "course", "section")


# ---- evaluation ----

# The golden set: a benchmark item expects the documents that hold its text.
_GOLD = f"{O.lexical(O.BENCHMARK)}, gold AS MATERIALIZED (SELECT b.item_id AS qid, CAST(d.doc_id AS VARCHAR) AS section, d.lang FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_RANKS = f"{_GOLD}, asked AS (SELECT qid, min(lang) AS lang FROM gold GROUP BY qid), first AS (SELECT qid, min(rank) + 1 AS r FROM hits JOIN chunks USING (id) JOIN gold USING (qid, section) GROUP BY qid), ranks AS (SELECT qid, lang, 'course' AS kind, CAST(coalesce(r, 0) AS BIGINT) AS r FROM asked LEFT JOIN first USING (qid))"


def _golden_ranks(spark: SparkSession, sf: str, planted: bool = False) -> DataFrame:
    """The items' texts are looked for only in documents that hold the item's rarest term; what is found is written once.

    ``planted`` lets every third item expect a document that isn't there.
    """
    items, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    index = index_of(spark, sf)
    passages = items.select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    holds = evaluate.holders(passages, docs.select("doc_id", "lang", "text"), index)
    absent = (F.col("qid") % 3 == 0) if planted else F.lit(False)
    section = F.when(absent, "absent").otherwise(F.col("doc_id").cast("string"))
    expect = F.struct(F.lit("course").alias("kind"), F.lit(None).cast("string").alias("course"), section.alias("section_contains"))
    gold = holds.groupBy("qid").agg(F.min("lang").alias("lang"), F.collect_list(expect).alias("expect"))
    hits = search_lexical(index, benchmark_queries(spark, sf)).join(index.chunks.select("id", "kind", "course", "section"), "id")
    exact = hits.join(holds.select("qid", section.alias("section")), ["qid", "section"], "left_semi")
    return evaluate.first_ranks(gold, exact)


@query(f"WITH {_RANKS} SELECT qid, lang, kind, r FROM ranks")
def q_eval_ranks(spark, sf):
    return _golden_ranks(spark, sf)


@query(
    f"WITH {_RANKS} SELECT CASE WHEN grouping(lang, kind) = 3 THEN 'ALL' WHEN grouping(lang, kind) = 1 THEN 'lang:' || lang ELSE 'kind:' || kind END AS grp, count(*) AS n, round(avg((r BETWEEN 1 AND 1)::INT), 6) AS r1, round(avg((r BETWEEN 1 AND 3)::INT), 6) AS r3, "
    "round(avg((r BETWEEN 1 AND 5)::INT), 6) AS r5, round(avg((r BETWEEN 1 AND 8)::INT), 6) AS rk, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE / r ELSE 0 END), 6) AS mrr FROM ranks GROUP BY GROUPING SETS ((), (lang), (kind))"
)
def q_eval_metrics(spark, sf):
    return evaluate.metrics(_golden_ranks(spark, sf)).select("grp", "n", *[six(c) for c in ("r1", "r3", "r5", "rk", "mrr")])


_PLANTED = _RANKS.replace("CAST(d.doc_id AS VARCHAR) AS section", "CASE WHEN b.item_id % 3 = 0 THEN 'absent' ELSE CAST(d.doc_id AS VARCHAR) END AS section")


@query(f"WITH {_PLANTED} SELECT qid, lang, kind FROM ranks WHERE r = 0")
def q_eval_misses(spark, sf):
    return evaluate.misses(_golden_ranks(spark, sf, planted=True))


_ASKED = [(1, "ferries"), (2, "nets"), (3, "talks"), (4, "nothing")]
_SAID = {c: f"json_extract_string(e, '$.{c}')" for c in ("kind", "course", "section_contains")}


@query(
    f"WITH {O.lexical(O.BENCHMARK)}, {X.values(X.GOLDEN, 'shown', 'line')}, g AS (SELECT * FROM shown UNION ALL {D.GOLDEN}), {X.values(X.HITS, 'shown_hits', 'qid, rank, kind, course, section')}, {X.values(_ASKED, 'shown_asked', 'qid, q')}, "
    "h AS (SELECT * FROM shown_hits UNION ALL SELECT qid + 100, rank, kind, course, section FROM hits JOIN chunks USING (id)), n AS (SELECT * FROM shown_asked UNION ALL SELECT qid + 100, q FROM queries), "
    "o AS (SELECT qid, q, json_extract_string(line, '$.lang') AS lang, CASE WHEN json_type(line, '$.expect') = 'ARRAY' THEN json_extract(line, '$.expect[*]') ELSE [json_extract(line, '$.expect')] END AS es FROM g JOIN n ON q = json_extract_string(line, '$.q')), "
    f"x AS (SELECT qid, unnest(es) AS e FROM o), m AS (SELECT qid, min(rank) + 1 AS r FROM x JOIN h USING (qid) WHERE ({_SAID['kind']} IS NULL OR {_SAID['kind']} = kind) AND ({_SAID['course']} IS NULL OR contains(lower(course), lower({_SAID['course']}))) "
    f"AND ({_SAID['section_contains']} IS NULL OR contains(section, {_SAID['section_contains']})) AND coalesce({_SAID['course']}, {_SAID['section_contains']}) IS NOT NULL GROUP BY qid) "
    "SELECT q, lang, coalesce(json_extract_string(es[1], '$.kind'), 'other') AS kind, CAST(coalesce(r, 0) AS INT) AS r FROM o LEFT JOIN m USING (qid)"
)
def q_golden_match(spark, sf):
    index, asked = index_of(spark, sf), benchmark_queries(spark, sf)
    numbers = X.frame(spark, _ASKED, "n long, q string").union(asked.select(F.col("qid") + 100, "q"))
    numbered = golden_lines(spark, sf).join(numbers, "q").select(F.col("n").alias("qid"), "q", "lang", "expect")
    found = search_lexical(index, asked).join(index.chunks.select("id", "kind", "course", "section"), "id")
    hits = X.frame(spark, X.HITS, "qid long, rank int, kind string, course string, section string").union(found.select(F.col("qid") + 100, "rank", "kind", "course", "section"))
    found = evaluate.first_ranks(numbered, hits).join(numbered.select("qid", "q"), "qid")
    return found.select("q", "lang", "kind", F.col("r").cast("int").alias("r"))


# ---- agent and chat ----

_SRC3 = "contains(lower(course), 'src3')"


@query(
    f"WITH {O.lexical(O.BENCHMARK, _SRC3, k=1)}, opening AS (SELECT section FROM chunks WHERE {_SRC3} ORDER BY \"order\" LIMIT 1), best AS (SELECT q.qid, coalesce(c.section, (SELECT section FROM opening)) AS section FROM queries q LEFT JOIN hits h USING (qid) LEFT JOIN chunks c USING (id)), "
    f"held AS (SELECT DISTINCT section, unnest({O.tokens('text')}) AS tok FROM chunks WHERE {_SRC3}), size AS (SELECT section, count(*) AS n_chunks FROM chunks WHERE {_SRC3} GROUP BY section), "
    "cov AS (SELECT b.qid, count(h.tok) / CAST(count(*) AS DOUBLE) AS coverage FROM best b JOIN terms t USING (qid) LEFT JOIN held h ON h.section = b.section AND h.tok = t.tok GROUP BY b.qid) "
    "SELECT qid, section, n_chunks, round(coverage, 6) AS coverage, coverage < 0.7 AS low FROM best JOIN size USING (section) JOIN cov USING (qid)"
)
def q_teach_section(spark, sf):
    return agent.teach_section(index_of(spark, sf), benchmark_queries(spark, sf), "src3").select("qid", "section", "n_chunks", six("coverage"), "low")


# Questions of three kinds: plain ones, ones that name a course, and ones that name a course and ask for what no text has.
_LOOP = "SELECT item_id AS qid, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN 'src' || item_id % 7 || ' ' || text ELSE 'src' || item_id % 7 || ' ' || substr(text, 1, 40) || repeat(' quux0 quux1 quux2 quux3 quux4 quux5 quux6 quux7 quux8 quux9 quux10 quux11', 1) END AS q FROM benchmark"
_PLANNED = (
    f"WITH asked AS ({_LOOP}), named AS (SELECT course, row_number() OVER (ORDER BY count(*) DESC, min(\"order\")) AS place FROM chunks GROUP BY course), said AS (SELECT qid, unnest(regexp_split_to_array(lower(q), '\\s+')) AS word FROM asked), "
    "picked AS (SELECT qid, arg_min(course, place) AS wish FROM said JOIN named ON length(word) > 2 AND contains(lower(course), word) GROUP BY qid) SELECT qid, q, wish FROM asked LEFT JOIN picked USING (qid)"
)
_TOPS = "coalesce(max(round(coverage, 2)) FILTER (rank = 0), 0) AS {0}, count(h.id) AS {1} FROM queries q LEFT JOIN hits h USING (qid) GROUP BY ALL"
_WISHED = "contains(lower(course), coalesce((SELECT lower(x.wish) FROM queries x WHERE x.qid = terms.qid), ''))"


@query(
    f"WITH bound AS (WITH {O.lexical(_PLANNED, _WISHED, k=24)} SELECT q.qid, q.wish, {_TOPS.format('c1', 'f1')}), free AS (WITH {O.lexical(_PLANNED, k=24)} SELECT q.qid, {_TOPS.format('c2', 'f2')}), "
    "r AS (SELECT *, CASE WHEN c1 >= 0.55 OR f1 = 0 THEN 1 WHEN wish IS NOT NULL AND (c2 >= 0.55 OR f2 = 0) THEN 2 ELSE 3 END AS rounds FROM bound JOIN free USING (qid)) "
    "SELECT qid, wish AS course, rounds, CASE WHEN rounds = 1 THEN c1 ELSE c2 END AS coverage, CASE WHEN rounds = 1 THEN least(f1, 8) WHEN rounds = 2 THEN least(f2, 8) WHEN wish IS NOT NULL THEN least(f2, 16) ELSE least(f2, 24) END AS n_hits, "
    "CASE WHEN rounds = 1 THEN f1 ELSE f2 END = 0 AS blocked FROM r"
)
def q_agent_search_loop(spark, sf):
    index = index_of(spark, sf)
    src = F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string"), F.lit(" "))
    unknown = F.lit("".join(f" quux{i}" for i in range(12)))
    q = F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, F.concat(src, "text")).otherwise(F.concat(src, F.substring("text", 1, 40), unknown))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), q.alias("q"))
    courses = index.chunks.groupBy("course").agg(F.struct((-F.count("*")).alias("less"), F.min("order").alias("first")).alias("place"))
    planned = agent.plan_courses(asked, courses)
    return agent.search_rounds(index, planned).join(planned.select("qid", "course"), "qid")


@query(
    f"WITH {O.lexical(O.BENCHMARK)} SELECT qid, string_agg('· ' || substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 180) || '… ⟨' || course || '·' || section || '⟩', {_NL} ORDER BY rank) AS answer FROM hits JOIN chunks USING (id) WHERE rank < 4 GROUP BY qid"
)
def q_agent_draft(spark, sf):
    index = index_of(spark, sf)
    return agent.draft(search_lexical(index, benchmark_queries(spark, sf)), index.chunks)


@query(
    f"WITH {X.values(X.MESSAGES, 'shown', 'k, t')}, m AS (SELECT * FROM shown UNION ALL SELECT usr * 1000 + turn + 100, t FROM ({D.CHAT})), s AS (SELECT k, trim(coalesce(t, ''), {O._WS}) AS t, lower(trim(coalesce(t, ''), {O._WS})) AS low FROM m) "
    "SELECT k, CASE WHEN t = '' OR low IN ('/help', 'help', '帮助', '?', '？') THEN 'help' WHEN low IN ('/courses', '/course', 'courses') THEN 'courses' WHEN low LIKE '/use%' THEN 'use' WHEN low LIKE '/whoami%' THEN 'whoami' WHEN low LIKE '/teach%' THEN 'teach' ELSE 'ask' END AS action, "
    f"CASE action WHEN 'use' THEN trim(substr(t, 5), {O._WS}) WHEN 'teach' THEN trim(substr(t, 7), {O._WS}) WHEN 'ask' THEN t ELSE '' END AS argument FROM s"
)
def q_route_command(spark, sf):
    chat = D.chat_rows(spark, sf).select((F.col("usr") * 1000 + F.col("turn") + 100).alias("k"), "t")
    return X.frame(spark, X.MESSAGES, "k long, t string").union(chat).withColumn("r", messages.route(F.col("t"))).select("k", "r.action", "r.argument")


@query(
    f"WITH {O.CHUNKS}, chat AS ({D.CHAT}), named AS (SELECT course, count(*) AS n, min(\"order\") AS first FROM chunks GROUP BY course), s AS (SELECT usr, turn, t AS raw, trim(coalesce(t, ''), {O._WS}) AS t, lower(trim(coalesce(t, ''), {O._WS})) AS low FROM chat), "
    "r AS (SELECT *, CASE WHEN t = '' OR low IN ('/help', 'help', '帮助', '?', '？') THEN 'help' WHEN low IN ('/courses', '/course', 'courses') THEN 'courses' WHEN low LIKE '/use%' THEN 'use' WHEN low LIKE '/whoami%' THEN 'whoami' WHEN low LIKE '/teach%' THEN 'teach' ELSE 'ask' END AS action, "
    f"CASE action WHEN 'use' THEN trim(substr(t, 5), {O._WS}) WHEN 'teach' THEN trim(substr(t, 7), {O._WS}) WHEN 'ask' THEN t ELSE '' END AS argument FROM s), "
    "w AS (SELECT DISTINCT argument FROM r WHERE action = 'use' AND argument <> ''), pick AS (SELECT argument, course AS picked FROM w JOIN named ON contains(lower(course), lower(argument)) QUALIFY row_number() OVER (PARTITION BY argument ORDER BY lower(course) <> lower(argument), n DESC, first) = 1), "
    "f AS (SELECT usr, turn, raw, action, r.argument, picked, last_value(picked IGNORE NULLS) OVER (PARTITION BY usr ORDER BY turn, raw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS course FROM r LEFT JOIN pick ON action = 'use' AND r.argument = pick.argument) "
    "SELECT usr, turn, action, argument, course, CASE WHEN action = 'use' AND argument = '' THEN 'usage' WHEN action = 'use' THEN CASE WHEN picked IS NULL THEN 'unknown' ELSE 'chosen' END WHEN action = 'teach' AND course IS NULL THEN 'choose_first' WHEN action = 'teach' AND argument = '' THEN 'usage' ELSE 'done' END AS outcome FROM f"
)
def q_chat_sessions(spark, sf):
    courses = index_of(spark, sf).chunks.groupBy("course").agg(F.count("*").alias("n"), F.min("order").alias("first"))
    return sessions.sessions(D.chat_rows(spark, sf), courses).drop("t")


@query(
    f"WITH lines AS ({D.ANSWERS}), ok_lines AS (SELECT json_extract_string(value, '$.custom_id') AS id, json_extract_string(value, '$.response.status_code') = '200' AS good FROM lines WHERE json_valid(value)), "
    "answers AS (SELECT id, count(*) AS n, bool_or(good) AS good FROM ok_lines GROUP BY id), asked AS (SELECT 'd' || doc_id AS id, min(CAST(floor(doc_id / 100) AS BIGINT)) AS shard FROM documents GROUP BY ALL), "
    "found AS (SELECT asked.id AS asked, shard, n, good FROM asked FULL JOIN answers ON asked.id = answers.id UNION ALL SELECT NULL, NULL, 1, NULL WHERE EXISTS (SELECT 1 FROM lines WHERE trim(value) <> '' AND NOT json_valid(value))) "
    "SELECT coalesce(shard, -1) AS shard, count(asked) AS requested, count(*) FILTER (asked IS NOT NULL AND good) AS ok, count(*) FILTER (asked IS NOT NULL AND NOT good) AS failed, count(*) FILTER (asked IS NOT NULL AND n IS NULL) AS missing, "
    "count(*) FILTER (shard IS NOT NULL AND n > 1) AS repeated, count(*) FILTER (asked IS NULL) AS stray, count(*) FILTER (asked IS NOT NULL AND good) = count(asked) AS complete FROM found GROUP BY shard"
)
def q_batch_fetch(spark, sf):
    requests = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("custom_id"), F.floor(F.col("doc_id") / 100).cast("long").alias("shard"))
    states = batch_fetch.shard_states(batch_fetch.reconcile(requests, D.answer_rows(spark, sf)))
    return states.withColumn("shard", F.coalesce("shard", F.lit(-1).cast("long")))
