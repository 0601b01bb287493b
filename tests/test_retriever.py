"""Backends, their modes and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.__main__ import main
from fathomline.functions.text import json_or
from fathomline.operators import vectors
from fathomline.operators.index import Index
from fathomline.plans.retriever import HybridRetriever, LexicalRetriever, Retriever, judge, open_retriever
from fathomline.schema import CHUNKS
from fathomline.sources import files
from fathomline.streaming.ingest import embed_missing

ROWS = [
    ("k1", "Rivers", "course", "raw", None, "source", 1, "a river begins at a spring in the hills"),
    ("k2", "Rivers", "course", "raw", None, "mouth", 2, "the river ends at the sea, in a delta of sand"),
    ("k3", "Bridges", "book", "raw", None, "p.1-8", 3, "an arch of stone carries the road over the river"),
]


def by_letters(rows):
    """A stand-in for a model: how often each letter occurs."""
    letters = [F.length(F.regexp_replace(F.lower("text"), f"[^{c}]", "")).cast("float") for c in "abcdefghijklmnopqrstuvwxyz"]
    return rows.select("id", F.array(*letters).alias("vec"))


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(spark.createDataFrame(ROWS, CHUNKS))


@pytest.fixture(scope="module")
def store(index):
    return by_letters(index.chunks)


def test_both_backends_answer_the_same_calls(spark, index, store):
    asked = spark.createDataFrame([(1, "a river begins at a spring"), (2, "zzz")], "qid int, q string")
    claims = spark.createDataFrame([(1, ROWS[0][-1], ["k1", "nope"]), (2, "x", ["nope"])], "qid int, claim string, chunk_ids array<string>")
    for backend in (open_retriever(index), open_retriever(index, store, by_letters, mode="hybrid")):
        assert isinstance(backend, Retriever)
        top = backend.search(asked).where("rank = 0").collect()
        assert next(r.id for r in top if r.qid == 1) == "k1"
        assert {r.id for r in backend.search(asked, kind="book").collect()} <= {"k3"}
        assert {r.id for r in backend.search(asked, course="rivers", k=1).where("qid = 1").collect()} == {"k1"}
        assert [r.course for r in backend.list_courses().collect()] == ["Rivers", "Bridges"]
        assert [r.section for r in backend.outline("river").collect()] == ["source", "mouth"]
        assert [r.id for r in backend.fetch_section("Rivers", "mouth").collect()] == ["k2"]
        assert {r.qid: r.supported for r in backend.verify(claims).collect()} == {1: True, 2: False}
        got = {r.qid: (r.verdict, r.method, r.real, r.fake) for r in judge(backend, claims).collect()}
        assert got == {1: ("SUPPORTED", backend.method, ["k1"], ["nope"]), 2: ("BLOCK", backend.method, [], ["nope"])}


def broken(rows):
    raise OSError("no such model")


@pytest.mark.parametrize(("gap", "embed", "reason"), [(True, by_letters, "have no vector"), (False, None, "no embedder"), (False, broken, "no such model"), (False, lambda r: by_letters(r).select("id", F.slice("vec", 1, 3).alias("vec")), "dimensions")])
def test_words_only_is_never_silent(index, store, gap, embed, reason):
    held = store.where("id <> 'k2'") if gap else store
    with pytest.warns(UserWarning, match=reason):
        backend = open_retriever(index, held, embed)
    assert type(backend) is LexicalRetriever and reason in backend.fallback
    with pytest.raises(ValueError, match=reason):
        open_retriever(index, held, embed, mode="hybrid")
    assert open_retriever(index, held, embed, mode="lexical").fallback is None


def test_command_line(spark, index, store, tmp_path, capsys):
    chunks, vecs = str(tmp_path / "c"), str(tmp_path / "v")
    files.write_chunks(index.chunks, chunks)
    files.append_vectors(store, vecs)

    def said(*argv):
        code = main(["--chunks", chunks, *argv], spark)
        out = capsys.readouterr()
        return code, out.out, out.err

    code, out, err = said("search", "spring in the hills", "--json")
    assert code == 0 and json.loads(out)[0]["id"] == "k1" and not err
    assert "Nothing found" in said("search", "zebra")[1]
    assert said("verify", "river of sand in a delta", "k2")[0] == 0
    assert said("verify", "zebra stripes", "k2")[0] == 2
    code, out, _ = said("verify", "zebra", "nope")
    assert code == 2 and json.loads(out)["verdict"] == "BLOCK"
    assert said("courses")[1] == "2\tRivers\n1\tBridges\n"
    assert said("outline", "bridges")[1] == "p.1-8\n" and "k3" in said("section", "Bridges", "p.1-8")[1]
    with pytest.warns(UserWarning):
        code, _, err = said("--vectors", vecs, "courses")
    assert code == 0 and "no embedder" in err
    code, out, err = said("--vectors", vecs, "--embedder", f"{__name__}:by_letters", "search", "a river begins at a spring", "--k", "1")
    assert code == 0 and "cos=" in out and not err
    assert main(["--chunks", str(tmp_path / "absent"), "courses"], spark) == 1


def test_only_what_lacks_a_vector_is_embedded(spark, index, tmp_path):
    chunks, vecs = str(tmp_path / "c"), str(tmp_path / "v")
    index.chunks.write.parquet(chunks)
    files.append_vectors(spark.createDataFrame([("k1", [9.0])], "id string, vec array<float>"), vecs)
    asked = []

    def make(rows):
        asked.append(sorted(r.id for r in rows.collect()))
        return rows.select("id", F.array(F.lit(1.0)).alias("vec"))

    embed_missing(spark, chunks, vecs, make)
    embed_missing(spark, chunks, vecs, make)
    assert asked == [["k2", "k3"], []]
    assert {r.id: list(r.vec) for r in files.read_vectors(spark, vecs).collect()} == {"k1": [9.0], "k2": [1.0], "k3": [1.0]}


def test_pages_of_pdfs_and_golden_files(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "pdf" / "b.txt").write_bytes(b"no")
    reader = lambda content: [(i + 1, t) for i, t in enumerate(content.decode().split("|"))]
    got = files.read_pdf_pages(spark, str(tmp_path / "pdf"), reader).orderBy("page").collect()
    assert [(g.page, g.text) for g in got] == [(1, "one"), (2, "two")] and got[0].pdf.endswith("a.pdf")
    (tmp_path / "g.jsonl").write_text('{"q": "x", "lang": "en", "expect": {"course": "c"}}\n\n{"q": "y", "lang": "en", "expect": [{"course": "c"}, {"kind": "book"}]}\n')
    assert {g.q: len(g.expect) for g in files.read_golden(spark, str(tmp_path / "g.jsonl")).collect()} == {"x": 1, "y": 2}


def test_shrunk_vectors_are_of_half_precision(spark):
    r = np.random.default_rng(4)
    rows = [(str(i), [float(x) for x in r.normal(size=12) * 10.0 ** r.integers(-6, 2)]) for i in range(200)] + [("zero", [0.0] * 12)]
    store = spark.createDataFrame(rows, "id string, vec array<double>")
    got = {g.id: np.array(g.vec) for g in vectors.truncated(store, 8).collect()}
    for name, vec in rows:
        x = np.array(vec[:8])
        x = x / (np.linalg.norm(x) or 1)
        assert np.array_equal(got[name], x.astype(np.float16).astype(float))
    full = vectors.truncated(store, 8, half=False).where("id = '3'").first().vec
    assert np.linalg.norm(full) == pytest.approx(1)
    with pytest.raises(Exception, match="cannot truncate"):
        vectors.truncated(store, 13).collect()


def test_json_that_does_not_parse_takes_the_default(spark):
    rows = spark.createDataFrame([(1, '{"a": 3}'), (2, "{broken"), (3, None), (4, ""), (5, "{}")], "k int, t string")
    got = {r.k: r.v.a for r in rows.select("k", json_or(F.col("t"), "a int", F.struct(F.lit(-1).alias("a"))).alias("v")).collect()}
    assert got == {1: 3, 2: -1, 3: -1, 4: -1, 5: None}


def test_vector_search_without_queries_or_vectors(spark, store):
    none = spark.createDataFrame([], "qid int, vec array<double>")
    assert vectors.topk(store, none, 3).count() == 0
    assert vectors.topk(store.where("false"), store.select(F.lit(1).alias("qid"), "vec").limit(1), 3).count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid int, vec array<double>")
    assert [r.qid for r in vectors.topk(spark.createDataFrame([("a", [1.0, 0.0])], "id string, vec array<double>"), mixed, 3).collect()] == [1]


def test_a_hybrid_backend_needs_all_vectors(spark, index, store):
    backend = HybridRetriever(index, store.where("id <> 'k2'"), by_letters)
    with pytest.raises(Exception, match="no vector for"):
        backend.search(spark.createDataFrame([(1, "river")], "qid int, q string")).collect()
