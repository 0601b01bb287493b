"""Incremental index, versioned stores and resumed embedding against states built at once."""

import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators.index import Index
from fathomline.operators.lexical import search_lexical
from fathomline.operators.live_index import LiveIndex, changes
from fathomline.operators.sections import assign_order
from fathomline.sources.versions import Conflict, Part, VectorStore, Version, Versions

_WORDS = "alpha beta gamma delta epsilon zeta eta theta 学习 率".split()
_ROWS = "rel string, ordinal int, id string, course string, kind string, layer string, series string, section string, text string"


def chunk(rel, n, text, section="s"):
    return (rel, n, f"{rel}-{n}", rel[0], "course", "raw", None, section, text)


def state(spark, seed, n=30):
    r = random.Random(seed)
    rows = [chunk(f"{r.choice('abc')}/{i}", 1, " ".join(r.choices(_WORDS, k=r.randint(0, 12)))) for i in range(n)]
    return spark.createDataFrame([*rows, chunk("z/null", 1, None, None), chunk("z/empty", 1, "")], _ROWS)


def found(index, queries):
    return {(h.qid, h.id, h.rank): (round(h.rrf, 9), round(h.bm25, 9), round(h.tfidf, 9), h.coverage) for h in search_lexical(index, queries).collect()}


def test_updates_score_like_a_rebuild(spark, tmp_path):
    queries = spark.createDataFrame([(1, "alpha beta beta"), (2, "学习率 zeta"), (3, "nothing"), (4, "")], "qid int, q string")
    live = LiveIndex(spark, str(tmp_path / "live"), fanout=3)
    for seed, n in ((1, 30), (1, 24), (2, 28), (2, 28), (3, 6)):
        rows = state(spark, seed, n)
        live.sync(rows)
        whole = Index.build(assign_order(rows))
        snapshot = live.snapshot()
        assert found(snapshot, queries) == found(whole, queries)
        assert {tuple(x) for x in snapshot.idf.collect()} == {tuple(x) for x in whole.idf.collect()}
        assert snapshot.stats.first() == whole.stats.first()
    # Three segments of a level became one, and hidden rows went with the merge of all.
    assert any(p.level for p in live.versions.latest().parts) and len(live.versions.latest().parts) < 5


def test_an_empty_state_and_one_after_it(spark, tmp_path):
    queries = spark.createDataFrame([(1, "alpha")], "qid int, q string")
    live = LiveIndex(spark, str(tmp_path / "live"))
    with pytest.raises(ValueError):
        live.snapshot()
    live.sync(state(spark, 1, 4))
    live.sync(state(spark, 1, 4).limit(0))
    assert not found(live.snapshot(), queries) and live.chunks().count() == 0
    live.sync(state(spark, 1, 4))
    assert live.chunks().count() == 6


def test_only_what_changed_is_written(spark, tmp_path):
    live = LiveIndex(spark, str(tmp_path / "live"))
    rows = state(spark, 4, 20)
    live.sync(rows, ("files", 0))
    edited = rows.withColumn("text", F.when(F.col("rel") == "z/empty", "a new text").otherwise(F.col("text")))
    got = live.sync(edited, ("files", 1))
    assert [tuple(r) for r in got.collect()] == [("z/empty-1", "changed")]
    newest = live.versions.latest()
    assert spark.read.parquet(f"{newest.parts[-1].path}/chunks").count() == 1
    # A batch that comes again is no new version.
    live.update(edited, None, ("files", 1))
    assert live.versions.latest() == newest
    live.versions.vacuum(keep=1)
    assert live.versions.numbers() == [newest.number] and live.chunks().count() == 22


def test_changes_tell_null_from_missing(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, print string")
    after = spark.createDataFrame([("b", "2"), ("c", "4"), ("d", "5")], "id string, print string")
    assert sorted(map(tuple, changes(before, after).collect())) == [("a", "removed"), ("c", "changed"), ("d", "added")]


def vectors(spark, ids):
    return spark.createDataFrame([(i, [float(n + 1), 1.0]) for n, i in enumerate(ids)], "id string, vec array<float>")


def test_a_store_shows_whole_versions(spark, tmp_path, monkeypatch):
    store = VectorStore(spark, str(tmp_path / "v"), buckets=4, fanout=3)
    assert store.read().count() == 0
    store.upsert(vectors(spark, "ab"), ("s", 0))
    kept = {r.id: r.vec for r in store.read().collect()}
    # A writer that dies between writing and the manifest leaves nothing behind that a reader sees.
    with monkeypatch.context() as m:
        m.setattr(Versions, "publish", lambda self, v: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.upsert(vectors(spark, "xyz"), ("s", 1))
    assert {r.id: r.vec for r in store.read().collect()} == kept
    store.upsert(vectors(spark, "cba"), ("s", 1))
    store.upsert(vectors(spark, "q"), ("s", 1))  # replayed: changes nothing
    now = {r.id: r.vec for r in store.read().collect()}
    assert sorted(now) == ["a", "b", "c"] and now["a"] == kept["a"]
    store.remove(spark.createDataFrame([("a",)], "id string"))
    assert sorted(r.id for r in store.read().collect()) == ["b", "c"]
    store.upsert(vectors(spark, "xa"))
    assert sorted(r.id for r in store.read().collect()) == ["a", "b", "c", "x"]
    with pytest.raises(Conflict):
        store.versions.publish(Version(1, (Part("p", 1),)))


def test_null_ids_and_vectors_and_repeats(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    rows = spark.createDataFrame([("a", [0.0, 2.0], 2), ("a", [3.0, 0.0], 1), (None, [1.0], 1), ("b", None, 1)], "id string, vec array<float>, pos int")
    store.upsert(rows)
    assert [(r.id, r.vec) for r in store.read().collect()] == [("a", [1.0, 0.0])]


def test_embedding_goes_on_where_it_was_killed(spark, tmp_path):
    source, store = str(tmp_path / "in"), VectorStore(spark, str(tmp_path / "v"), buckets=2)
    for n in range(5):
        spark.createDataFrame([(f"{n}-{i}", f"text {i}") for i in range(3)], "id string, text string").coalesce(1).write.mode("append").parquet(source)
    calls, done = [], []

    def make(rows):
        if len(calls) == 2 and not done:
            raise RuntimeError("killed")
        calls.append(sorted(r.id for r in rows.collect()))
        return rows.select("id", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("vec"))

    from fathomline.streaming.ingest import embed_stream

    run = lambda: embed_stream(spark, source, store, str(tmp_path / "ck"), make, files=1).awaitTermination()
    with pytest.raises(Exception, match="killed"):
        run()
    assert store.read().count() == 6
    done.append(True)
    run()
    assert store.read().count() == 15 and sorted(i for c in calls for i in c) == sorted(f"{n}-{i}" for n in range(5) for i in range(3))
    run()
    assert len(calls) == 5
