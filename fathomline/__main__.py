"""``python -m fathomline --chunks PATH COMMAND``: one question at a time over a chunk table.

Exit codes: 0 done, 1 no chunks, 2 a claim that its citations don't support.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import clip, collapse
from fathomline.operators.index import Index
from fathomline.plans.retriever import LexicalRetriever, judge, open_retriever
from fathomline.schema import KINDS
from fathomline.sources.files import read_chunks, read_vectors

SHOWN = 700


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="fathomline", description="Search a chunk table, read it, and check claims against it.")
    parser.add_argument("--chunks", required=True, help="chunk rows as JSON lines")
    parser.add_argument("--vectors", help="the vector store")
    parser.add_argument("--embedder", help="module:function from a table id, text to a table id, vec")
    parser.add_argument("--mode", choices=["auto", "hybrid", "lexical"], default="auto")
    commands = parser.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--k", type=int, default=8)
    search.add_argument("--course")
    search.add_argument("--kind", choices=KINDS)
    search.add_argument("--full", action="store_true", help="whole texts")
    search.add_argument("--json", action="store_true")
    section = commands.add_parser("section")
    section.add_argument("course")
    section.add_argument("section")
    commands.add_parser("outline").add_argument("course")
    check = commands.add_parser("verify")
    check.add_argument("claim")
    check.add_argument("chunk_ids", nargs="+")
    commands.add_parser("courses")
    return parser.parse_args(argv)


def _rows(df: DataFrame):
    return df.toLocalIterator()


def _search(spark: SparkSession, retriever: LexicalRetriever, a: argparse.Namespace) -> int:
    hits = retriever.search(spark.createDataFrame([(0, a.query)], "qid int, q string"), a.course, a.kind, a.k).drop("qid")
    found = hits.join(retriever.index.chunks, "id").orderBy("rank").collect()  # k rows
    if a.json:
        print(json.dumps([r.asDict() for r in found], ensure_ascii=False))
    elif not found:
        print("Nothing found; try other words, or no --course and --kind.")
    else:
        shown = {r.id: r.shown for r in spark.createDataFrame([(r.id, r.text) for r in found], "id string, text string").select("id", (collapse(F.col("text")) if a.full else clip(F.col("text"), SHOWN)).alias("shown")).collect()}
        for r in found:
            score = f"cos={r.cos:.3f} " if "cos" in hits.columns else ""
            print(f"[{r['rank'] + 1}] id={r.id} {score}cov={r.coverage:.2f} [{r.kind}] {r.course} / {r.section}\n{shown[r.id]}")
    return 0


def _verify(spark: SparkSession, retriever: LexicalRetriever, a: argparse.Namespace) -> int:
    claim = spark.createDataFrame([(0, a.claim, a.chunk_ids)], "qid int, claim string, chunk_ids array<string>")
    row = judge(retriever, claim).first().asDict()
    del row["qid"]
    print(json.dumps(row | {"score": round(row["score"], 3)}, ensure_ascii=False))
    return 0 if row["verdict"] == "SUPPORTED" else 2


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _arguments(argv)
    spark = spark or SparkSession.builder.appName("fathomline").getOrCreate()
    try:
        chunks = read_chunks(spark, a.chunks)
    except AnalysisException:
        print(f"no chunks at {a.chunks}", file=sys.stderr)
        return 1
    embed = None
    if a.embedder:
        module, name = a.embedder.split(":")
        embed = getattr(importlib.import_module(module), name)
    # Without --vectors nobody asked for them, so there is nothing to fall back from.
    mode = "lexical" if a.mode == "auto" and not a.vectors else a.mode
    retriever = open_retriever(Index.build(chunks), read_vectors(spark, a.vectors) if a.vectors else None, embed, mode=mode)
    if retriever.fallback:
        print(f"searching by words only: {retriever.fallback}", file=sys.stderr)
    if a.command == "search":
        return _search(spark, retriever, a)
    if a.command == "verify":
        return _verify(spark, retriever, a)
    if a.command == "section":
        lines = (f"id={r.id}\n{r.text}" for r in _rows(retriever.fetch_section(a.course, a.section)))
    elif a.command == "outline":
        lines = (r.section for r in _rows(retriever.outline(a.course)))
    else:
        lines = (f"{r.n}\t{r.course}" for r in _rows(retriever.list_courses()))
    for line in lines:
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
