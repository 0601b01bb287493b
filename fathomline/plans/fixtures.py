"""Small inline inputs that queries take beside the driver's tables: odd headings, page markers, subtitles, CJK, chat, PDFs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PAGE = "窗外的雨下了一整夜，河水慢慢涨到了桥边。" * 6

FILES = [
    ("Sample_Course/lesson01.md", "# 潮汐从哪里来\n月亮和太阳的引力让海水每天涨落两次，朔望时最高，上下弦时最低，港口的潮表就是这样算出来的。\n\n## Bread 发酵\nYeast turns sugar into gas, and the dough rises while gluten holds the bubbles in place.\n### 空\n   \n## GPS 定位原理\n接收机比较四颗卫星的信号到达时间，解出三个坐标和自己的钟差，再换算成地图上的一点。"),
    ("course/S1/S2/My_C/plain.txt", "intro line before any heading\n## Not a heading here\nbody text that goes on for more than forty characters in total."),
    ("book/Big_Book/pages.txt", "lost preamble\n" + "\n".join(f"[p.{i}]\n" + ("Chapter 1 Start\n" if i == 9 else "") + _PAGE for i in range(1, 21))),
    ("book/Small/nomark.txt", "只有一段散文，没有任何编号。" * 15),
    ("Video_A_B/talk.vtt", "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\nHello <c>there</c> everyone\n\n2\n00:00:02.000 --> 00:00:03.000\nHello there everyone\nand welcome to this talk about retrieval\n\n3\n00:00:03.000 --> 00:00:04.000\nand welcome to this talk about retrieval\nKind: captions"),
    ("f.txt", "too high to be classified, so it is skipped by the walk over the corpus"),
    ("book/T/_hidden.txt", "skipped because of its name, whatever it holds inside the file body"),
    ("data/x/table.csv", "skipped because of its suffix"),
]
PATHS = ["book/T/f.txt", "course/S1/S2/My_C/f.md", "course/f.txt", "Video_A_B/f.vtt", "f.txt", "Book_The_Art/x.TXT", "DATA/set_1/sub/y.srt", "A/z.txt", "a/b/c.txt", "a/b.txt", "a-b/c.txt", "a.b/c.txt", "notes/_skip.md", "notes/readme.pdf"]
STRINGS = ["Temperature 随机性 x A1", "", "监 督学习 é café 2024", "RRF混合检索 a bb", "a  b\tc\nd   long text " * 12]
MESSAGES = [(1, "/help"), (2, "  ? "), (3, "/courses"), (4, "/use  Deep Learning "), (5, "/useless"), (6, "/whoami now"), (7, "/teach gradient descent"), (8, "What is BM25?"), (9, ""), (10, "帮助")]
PDF_PAGES = [("a.pdf", 1, "x" * 400), ("a.pdf", 2, "y" * 200), ("a.pdf", 3, " "), ("scan.pdf", 1, "id"), ("scan.pdf", 2, ""), ("short.pdf", 1, "a little text on it"), ("mixed.pdf", 1, "z" * 900), ("mixed.pdf", 2, ""), ("mixed.pdf", 3, None)]
RESPONSES = [
    '{"custom_id": "a1", "error": null, "response": {"status_code": 200, "body": {"data": [{"embedding": [0.5, 0.25]}]}}}',
    '{"custom_id": "a2", "error": "rate", "response": {"status_code": 200, "body": {"data": [{"embedding": [1.0]}]}}}',
    '{"custom_id": "a3", "response": {"status_code": 500, "body": null}}',
    "",
    '{"custom_id": "a4", "response": {"status_code": 200, "body": {"data": [{"embedding": [0.125, -2.0, 3.5]}]}}}',
]
HITS = [(1, 0, "book", "远行的人与河", "p.41-48 · 第5章 雨夜渡口"), (1, 1, "course", "Deep Learning", "intro"), (2, 0, "book", "远行的人与河", "p.1-8"), (2, 1, "book", "远行的人与河", "p.41-48 · 第5章 雨夜渡口"), (3, 0, "video", "Talks", "one"), (4, 0, "data", "Sets", "s")]
GOLDEN = [
    '{"q": "ferries", "lang": "zh", "expect": {"kind": "book", "course": "远行", "section_contains": "渡口"}}',
    '{"q": "nets", "lang": "en", "expect": [{"course": "deep"}, {"section_contains": "渡口"}]}',
    '{"q": "talks", "lang": "en", "expect": {"kind": "course", "course": "Talks"}}',
    '{"q": "nothing", "lang": "en", "expect": {"kind": "data"}}',
]


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(rows: list, name: str, columns: str) -> str:
    """A common table expression of the same rows."""
    body = ", ".join("(" + ", ".join(literal(v) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"
