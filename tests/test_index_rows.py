"""Chunks, norms and scores from rows that stay where they are, against the plain ways."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions.text import strip_column
from fathomline.operators import evaluate, index as index_module, lexical, sections
from fathomline.operators.index import Index, doc_freq, idf_stats, postings
from fathomline.operators.lexical import lexical_scores, search_lexical
from fathomline.schema import CHUNKS, SearchConfig
from fathomline.sources.tables import PLACE, Tables, in_blocks

_WORDS = [f"w{i}" for i in range(40)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(n=300):
    r = random.Random(5)
    text = lambda: " ".join(min(r.choices(_WORDS, k=3)) for _ in range(r.choice((2, 6, 40, 150))))
    rows = [(f"c{i}", r.choice(("Nets", "nests", None)), r.choice(("course", "book")), "raw", None, f"s{i % 9}", i, text()) for i in range(n)]
    return [*rows, *[(f"copy{i}", *rows[i][1:6], n + i, rows[i][7]) for i in range(0, 60, 2)], ("empty", "Nets", "book", "raw", None, None, n + 99, None)]


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(spark.createDataFrame(corpus(), CHUNKS).repartition(5))


@pytest.fixture(scope="module")
def queries(spark):
    r = random.Random(6)
    rows = [(q, " ".join(r.choices(_WORDS, k=r.choice((1, 3, 12))))) for q in range(12)]
    return spark.createDataFrame([*rows, (90, "unheard of"), (91, None), (None, "w1 w2")], "qid int, q string")


def fused(scored, config, k):
    by = lambda c, *t: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round(c, 9)), *t)) - 1
    ranked = scored.withColumn("a", by("bm25", "order")).withColumn("b", by("tfidf", "order")).withColumn("rrf", 1 / (config.rrf_k + F.col("a")) + 1 / (config.rrf_k + F.col("b")))
    return sorted(tuple(r) for r in ranked.withColumn("rank", by("rrf", "a", "order")).where(F.col("rank") < k).select("qid", "rank", "id", F.round("rrf", 12)).collect())


def test_scores_and_ordered_chunks_need_no_shuffle(spark, index, queries):
    assert "Exchange" not in plan(lexical_scores(index, queries))
    files = [(f"course/{s}/{n}.txt", "course", s, None, 0, str(n), f"{s} {n} " * (40 * n)) for s in ("b", "a") for n in (12, 3, 0)]
    found = spark.createDataFrame([*files, files[0]], "rel string, kind string, course string, series string, nth int, title string, body string").repartition(3)
    made, plain = sections.ordered_chunks(found), sections.assign_order(sections.chunks(found))
    assert "Exchange" not in plan(made)
    assert sorted(made.select("order", "rel", "ordinal", "id", "text").collect()) == sorted(plain.select("order", "rel", "ordinal", "id", "text").collect())


@pytest.mark.parametrize("rrf_k, k", [(60, 8), (1, 2), (3, 20)])
def test_the_best_of_tasks_are_the_best_of_all_pairs(index, queries, rrf_k, k):
    config = SearchConfig(rrf_k=rrf_k)
    found = search_lexical(index, queries, config, k=k)
    assert sorted((r.qid, r["rank"], r.id, round(r.rrf, 12)) for r in found.collect()) == fused(lexical_scores(index, queries, config), config, k)


def test_few_rows_of_tasks_are_enough_to_count_places(spark, queries, monkeypatch):
    """Matrices of a few rows, blocks of two queries, and places that only a second pass knows."""
    monkeypatch.setattr(lexical, "CELLS", 64)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)
    passes = []
    monkeypatch.setattr(lexical, "_ahead", lambda *a, made=lexical._ahead: passes.append(1) or made(*a))
    index = Index.build(spark.createDataFrame(corpus(80), CHUNKS).repartition(3))
    scope = spark.createDataFrame([(q, ("NETS", "es", None)[q % 3]) for q in range(11)], "qid int, course string")
    config = SearchConfig(rrf_k=1, k1=0.2, b=1.0)
    found = search_lexical(index, queries, config, k=2, scope=scope)
    scored = lexical_scores(index, queries, config).join(index.terms.select("id", "course"), "id").join(scope.withColumnRenamed("course", "wish"), "qid")
    scored = scored.where("wish is null or contains(lower(course), lower(wish))")
    assert sorted((r.qid, r["rank"], r.id, round(r.rrf, 12)) for r in found.collect()) == fused(scored, config, 2) and passes


def test_norms_of_rare_and_frequent_terms(spark, index, monkeypatch):
    chunks = spark.createDataFrame(corpus(), CHUNKS)
    posts = postings(chunks)
    weight = F.col("tf") * F.col("idf_tfidf")
    wanted = {r.id: r.norm for r in posts.join(idf_stats(doc_freq(posts), index.stats), "tok").groupBy("id").agg(F.sqrt(F.sum(weight * weight)).alias("norm")).collect()}
    monkeypatch.setattr(index_module, "FREQUENT", 12)
    for built in (index, Index.build(chunks)):
        got = {r.id: r.norm for r in built.terms.select("id", "norm").collect()}
        assert got.pop("empty") == 0.0 and got == pytest.approx(wanted)


def test_rows_are_joined_block_by_block(spark):
    tables = Tables(spark, "test")
    rows = tables.write(spark.range(100).repartition(4).withColumn(PLACE, F.monotonically_increasing_id()))
    found = tables.write(rows.where("id % 10 <> 3").select(PLACE, (-F.col("id")).alias("minus")))
    parts = [part.collect() for part in in_blocks(rows, found, 7)]
    assert max(map(len, parts)) <= 7 and len(parts) > 12
    assert sorted((r.id, r.minus) for part in parts for r in part) == [(i, -i) for i in range(100) if i % 10 != 3]


def test_passages_are_found_where_their_rarest_term_is(spark, index):
    docs = spark.createDataFrame([(1, "en", "a w1 w2, w3"), (2, "de", "w1 w2, w3 and !?"), (3, "en", "w2 w1"), (4, "en", None), (5, None, "zz")], "doc_id long, lang string, text string")
    passages = spark.createDataFrame([(1, "w1 w2, w3"), (2, "!?"), (3, "zz"), (4, None), (5, "w9")], "qid int, passage string")
    assert sorted(map(tuple, evaluate.holders(passages, docs, index).collect())) == [(1, 1, "en"), (1, 2, "de"), (2, 2, "de"), (3, 5, None)]


def test_strip_looks_at_both_ends(spark):
    texts = ["", " ", "a", " a", "a\n", "\u2028a b\x1c", "\u3000", "a\n\n", "b \n c", "\x85x", "\U0001f600 ", None]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", strip_column(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [None if t is None else t.strip() for t in texts]
