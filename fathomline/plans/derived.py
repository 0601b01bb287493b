"""Tables that the driver's tables lack, made from them in Spark and in SQL.

Documents become files with headings, page markers or timings, paths and PDF
pages; embeddings become response lines, benchmark items golden lines, and
conversations chats with commands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import table

_NL = "chr(10)"


def _by_line(f) -> Column:
    return F.array_join(F.transform(F.split("text", "\n"), f), "\n")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---- files ``rel, text``: by doc_id % 4 with headings, page markers, timings, or as they are ----

FILES = (
    "SELECT CASE doc_id % 4 WHEN 0 THEN 'Notes_' || source || '/' || doc_id || '.md' WHEN 1 THEN 'book/' || source || '/' || doc_id || '.txt' WHEN 2 THEN 'Video_' || lang || '/' || doc_id || '.vtt' ELSE 'data/' || lang || '_set/' || source || '/' || doc_id || '.txt' END AS rel, "
    f"CASE doc_id % 4 WHEN 0 THEN '# ' || source || {_NL} || array_to_string(list_transform(string_split(text, {_NL}), lambda l, i: CASE WHEN i % 3 = 0 THEN '## part ' || i || {_NL} || l ELSE l END), {_NL}) "
    f"WHEN 1 THEN array_to_string(list_transform(string_split(text, {_NL}), lambda l, i: '[p.' || i || ']' || {_NL} || CASE WHEN i % 5 = 0 THEN 'Chapter ' || i || ' of ' || source || {_NL} ELSE '' END || l), {_NL}) "
    f"WHEN 2 THEN 'WEBVTT' || {_NL} || {_NL} || array_to_string(list_transform(string_split(text, {_NL}), lambda l, i: i || {_NL} || '00:00:' || lpad(CAST(i % 60 AS VARCHAR), 2, '0') || '.000 --> 00:01:00.000' || {_NL} || '<c>' || l || '</c>' || {_NL} || l), {_NL}) "
    "ELSE text END AS text FROM documents"
)


def file_rows(spark: SparkSession, sf: str) -> DataFrame:
    n, source, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    kind = n % 4
    rel = (
        F.when(kind == 0, _text("Notes_", source, "/", n, ".md"))
        .when(kind == 1, _text("book/", source, "/", n, ".txt"))
        .when(kind == 2, _text("Video_", lang, "/", n, ".vtt"))
        .otherwise(_text("data/", lang, "_set/", source, "/", n, ".txt"))
    )
    headed = _text("# ", source, "\n", _by_line(lambda l, i: F.when(i % 3 == 2, _text("## part ", i + 1, "\n", l)).otherwise(l)))
    paged = _by_line(lambda l, i: _text("[p.", i + 1, "]\n", F.when(i % 5 == 4, _text("Chapter ", i + 1, " of ", source, "\n")).otherwise(""), l))
    timed = _text("WEBVTT\n\n", _by_line(lambda l, i: _text(i + 1, "\n00:00:", F.lpad(((i + 1) % 60).cast("string"), 2, "0"), ".000 --> 00:01:00.000\n<c>", l, "</c>\n", l)))
    text = F.when(kind == 0, headed).when(kind == 1, paged).when(kind == 2, timed).otherwise(F.col("text"))
    return table(spark, sf, "documents").select(rel.alias("rel"), text.alias("text"))


# ---- paths ``rel``: buckets, prefixes, hidden files, foreign suffixes, too high ----

PATHS = (
    "SELECT CASE doc_id % 6 WHEN 0 THEN 'course/' || source || '/' || doc_id || '.txt' WHEN 1 THEN 'Book_' || source || '_' || lang || '/' || doc_id || '.md' WHEN 2 THEN 'DATA/' || lang || '_set/' || source || '/sub/' || doc_id || '.vtt' "
    "WHEN 3 THEN source || '/_' || doc_id || '.srt' WHEN 4 THEN doc_id || '.TXT' ELSE 'Video_' || lang || '/' || doc_id || '.pdf' END AS rel FROM documents"
)


def path_rows(spark: SparkSession, sf: str) -> DataFrame:
    n, source, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    kind = n % 6
    rel = (
        F.when(kind == 0, _text("course/", source, "/", n, ".txt"))
        .when(kind == 1, _text("Book_", source, "_", lang, "/", n, ".md"))
        .when(kind == 2, _text("DATA/", lang, "_set/", source, "/sub/", n, ".vtt"))
        .when(kind == 3, _text(source, "/_", n, ".srt"))
        .when(kind == 4, _text(n, ".TXT"))
        .otherwise(_text("Video_", lang, "/", n, ".pdf"))
    )
    return table(spark, sf, "documents").select(rel.alias("rel"))


# ---- PDF pages ``pdf, page, text``: a document's lines; of every third document most pages are without text ----

PDF_PAGES = (
    f"SELECT doc_id || '.pdf' AS pdf, CAST(page AS INT) AS page, CASE WHEN doc_id % 3 = 0 AND page % 2 = 0 THEN NULL ELSE line END AS t FROM (SELECT doc_id, unnest(string_split(text, {_NL})) AS line, generate_subscripts(string_split(text, {_NL}), 1) AS page FROM documents)"
)


def pdf_rows(spark: SparkSession, sf: str) -> DataFrame:
    split = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    blank = (F.col("doc_id") % 3 == 0) & (F.col("at") % 2 == 1)
    return split.select(_text(F.col("doc_id"), ".pdf").alias("pdf"), (F.col("at") + 1).alias("page"), F.when(~blank, F.col("line")).alias("text"))


# ---- texts ``k, t`` of which every third has a chapter's title ----

TITLED = f"SELECT doc_id + 100 AS k, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 30) || {_NL} || '  Chapter ' || doc_id % 1000 || ' ' || source || {_NL} || text ELSE text END AS t FROM documents"


def titled_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    titled = _text(F.substring("text", 1, 30), "\n  Chapter ", n % 1000, " ", F.col("source"), "\n", F.col("text"))
    return table(spark, sf, "documents").select((n + 100).alias("k"), F.when(n % 3 == 0, titled).otherwise(F.col("text")).alias("t"))


# ---- response lines of an embedding service; some failed ----

RESPONSES = (
    "SELECT CAST(json_object('custom_id', 'v' || vec_id, 'error', CASE WHEN vec_id % 5 = 0 THEN 'rate' END, 'response', json_object('status_code', CASE WHEN vec_id % 7 = 0 THEN 500 ELSE 200 END, "
    "'body', json_object('data', json_array(json_object('embedding', CAST(embedding AS DOUBLE[])))))) AS VARCHAR) AS line FROM embeddings"
)


def response_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("vec_id")
    vector = F.struct(F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    response = F.struct(F.when(n % 7 == 0, 500).otherwise(200).alias("status_code"), F.struct(F.array(vector).alias("data")).alias("body"))
    line = F.to_json(F.struct(_text("v", n).alias("custom_id"), F.when(n % 5 == 0, "rate").alias("error"), response.alias("response")))
    return table(spark, sf, "embeddings").select(line.alias("value"))


# ---- golden lines: a benchmark item's text, with one expectation or two ----

GOLDEN = (
    "SELECT CAST(json_object('q', text, 'lang', CASE WHEN item_id % 3 = 0 THEN 'en' ELSE 'zh' END, 'expect', CASE WHEN item_id % 2 = 0 THEN CAST(json_object('kind', 'course', 'course', 'SRC' || item_id % 7) AS JSON) "
    "ELSE CAST(json_array(json_object('course', 'src' || item_id % 5), json_object('kind', 'book', 'section_contains', '1')) AS JSON) END) AS VARCHAR) AS line FROM benchmark"
)


def golden_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("item_id")
    one = F.to_json(F.struct(F.lit("course").alias("kind"), _text("SRC", n % 7).alias("course")))
    two = F.to_json(F.array(F.struct(F.lit(None).cast("string").alias("kind"), _text("src", n % 5).alias("course"), F.lit(None).cast("string").alias("section_contains")), F.struct(F.lit("book").alias("kind"), F.lit(None).cast("string").alias("course"), F.lit("1").alias("section_contains"))))
    head = F.to_json(F.struct(F.col("text").alias("q"), F.when(n % 3 == 0, "en").otherwise("zh").alias("lang")))
    line = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(', "expect": '), F.when(n % 2 == 0, one).otherwise(two), F.lit("}"))
    return table(spark, sf, "benchmark").select(line.alias("value"))


# ---- chat messages ``usr, turn, t``: a conversation's turns, some of them commands ----

CHAT = (
    "SELECT conv_id AS usr, turn, CASE (conv_id + turn * 5) % 9 WHEN 0 THEN '/use src' || conv_id % 12 WHEN 1 THEN '/teach ' || substr(text, 1, 20) WHEN 2 THEN '/courses' WHEN 3 THEN '  ? ' WHEN 4 THEN '/use' WHEN 5 THEN '/USE  RC' || turn % 12 || ' ' ELSE text END AS t FROM conversations"
)


def chat_rows(spark: SparkSession, sf: str) -> DataFrame:
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    kind = (conv + turn * 5) % 9
    said = (
        F.when(kind == 0, _text("/use src", conv % 12))
        .when(kind == 1, _text("/teach ", F.substring(text, 1, 20)))
        .when(kind == 2, F.lit("/courses"))
        .when(kind == 3, F.lit("  ? "))
        .when(kind == 4, F.lit("/use"))
        .when(kind == 5, _text("/USE  RC", turn % 12, " "))
        .otherwise(text)
    )
    return table(spark, sf, "conversations").select(conv.alias("usr"), turn.alias("turn"), said.alias("t"))


# ---- answers ``value`` to a request for each document, a hundred to a shard; in odd shards some fail or are missing, some ids are answered twice, some lines are cut, and some ids nobody asked for ----

_GOOD = "'{\"custom_id\": \"d' || doc_id || '\", \"response\": {\"status_code\": 200, \"body\": {\"data\": [{\"embedding\": [' || doc_id || '.5, 1.0]}]}}}'"
_BAD = "'{\"custom_id\": \"d' || doc_id || '\", \"response\": {\"status_code\": 429, \"body\": null}}'"
_ODD = "floor(doc_id / 100) % 2 = 1"
ANSWERS = (
    f"SELECT {_GOOD} AS value FROM documents WHERE NOT ({_ODD} AND (doc_id % 11 = 0 OR doc_id % 7 = 0)) UNION ALL SELECT {_BAD} FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT {_GOOD} FROM documents WHERE doc_id % 13 = 0 AND NOT {_ODD} "
    f"UNION ALL SELECT substr({_GOOD}, 1, 30) FROM documents WHERE doc_id % 17 = 0 UNION ALL SELECT replace({_GOOD}, '\"d', '\"x') FROM documents WHERE doc_id % 19 = 0 UNION ALL SELECT ' ' FROM documents WHERE doc_id % 23 = 0"
)


def answer_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    odd = F.floor(n / 100) % 2 == 1
    good = _text('{"custom_id": "d', n, '", "response": {"status_code": 200, "body": {"data": [{"embedding": [', n, ".5, 1.0]}]}}}")
    bad = _text('{"custom_id": "d', n, '", "response": {"status_code": 429, "body": null}}')
    lines = F.array(
        F.when(~(odd & ((n % 11 == 0) | (n % 7 == 0))), good),
        F.when(n % 7 == 0, bad),
        F.when((n % 13 == 0) & ~odd, good),
        F.when(n % 17 == 0, F.substring(good, 1, 30)),
        F.when(n % 19 == 0, F.replace(good, F.lit('"d'), F.lit('"x'))),
        F.when(n % 23 == 0, " "),
    )
    return table(spark, sf, "documents").select(F.explode(lines).alias("value")).where("value is not null")
