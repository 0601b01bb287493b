"""Vector codes, neighbour graphs and ranked search against brute force, over awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from fathomline.llm.neighbour_graph import Graph, NeighbourGraph, _lifted
from fathomline.llm.queries import OP13_SQL, _op11_sql, op11_vector_codes, op12_neighbour_graph, op13_ranked_search
from fathomline.llm.ranked_search import RankedSearch, terms_of
from fathomline.llm.vector_codes import Codebook, VectorCodes

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, error long, code string, id long, v int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    """Vectors with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, l, 7, "z", 5, 1) for i, v, l in rows], VECTORS)


def awkward_vectors(seed=3, n=300, dim=16):
    r = random.Random(seed)
    f = lambda: [float(np.float32(r.gauss(0, 0.3))) for _ in range(dim)]
    rows = [(i, f(), r.choice([0, 1, 2, None])) for i in range(n)]
    rows += [(n + i, list(rows[5][1]), 1) for i in range(60)]  # copies
    rows += [(n + 100 + i, [x + 0.001 * r.random() for x in rows[7][1]], 0) for i in range(60)]  # near copies
    rows += [(n + 200, None, 0), (n + 201, [], 0), (n + 202, [1.0] * (dim - 1) + [None], 0), (n + 203, [NAN] * dim, 0), (n + 204, [INF] + [0.0] * (dim - 1), None)]
    rows += [(n + 205, [0.0] * dim, None), (n + 205, [0.0] * dim, None), (4, f(), 2), (4, list(rows[4][1]), 2), (None, f(), 1), (n + 206, f() + f(), 1), (n + 207, f()[:5], 1)]
    return rows


# ---- vector codes ----


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """As the contract says it, one row at a time."""
    ok = [(i, v, l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    whole = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], l) for i, v, l in ok]
    whole.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    whole = [r for r in whole if len(r[1]) == len(whole[0][1])]
    w = len(whole[0][1]) // parts
    cut = lambda x: [tuple(x[p * w : (p + 1) * w]) for p in range(parts)]
    books = [[cut(x)[p] for _, x, _ in whole[:entries]] for p in range(parts)]
    near = lambda c, book: min((sum((a - b) ** 2 for a, b in zip(c, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, x, _ in whole:
                members.setdefault(near(cut(x)[p], books[p])[1], []).append(cut(x)[p])
            books[p] = [tuple(sum(c) // len(members[j]) for c in zip(*members[j])) if j in members else e for j, e in enumerate(books[p])]
    out, by_label = [], Counter()
    for i, x, l in whole:
        found = [near(c, book) for c, book in zip(cut(x), books)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), l))
        by_label[l] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[l], digest) for i, c, e, l in out), key=repr)


def test_vector_codes_against_plain_python(spark):
    rows = awkward_vectors()
    got = VectorCodes().encode(vectors(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_codes(rows)
    few = [r for r in rows if r[0] in (1, 2, 3)]
    assert sorted(map(tuple, VectorCodes().encode(vectors(spark, few)).collect()), key=repr) == plain_codes(few)
    assert VectorCodes().encode(vectors(spark, [])).count() == 0
    assert VectorCodes().encode(vectors(spark, [(1, None, 0), (2, [1.0, 2.0], 0)])).count() == 0
    with pytest.raises(Exception, match="too large"):
        VectorCodes().encode(vectors(spark, [(1, [1e30] * 8, 0)])).collect()


def test_vector_codes_decode(spark):
    rows = vectors(spark, awkward_vectors()[:300])
    codec = VectorCodes()
    table = codec.encode(rows).orderBy("vec_id").toArrow()
    books = codec.codebooks(rows)
    back = codec.decode(table.column("code"), books)
    whole = np.floor(4096 * np.array([r.embedding for r in rows.orderBy("vec_id").collect()]))
    assert (((whole - back) ** 2).sum(axis=1) == table.column("error").to_numpy()).all()
    assert codec.digest(books) == table.column("codebooks_sha256")[0].as_py()


def test_annulus_keeps_ties_and_edges():
    r = np.random.default_rng(1)
    for _ in range(200):
        book = r.integers(-4, 5, (r.integers(1, 17), 3))  # many equal norms, equal entries and equal distances
        x = r.integers(-5, 6, (50, 3))
        index, best = Codebook(book).nearest(x)
        every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (best == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()


def test_vector_codes_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, op11_vector_codes(spark, SF).collect())) == sorted(con.sql(_op11_sql()).fetchall())


# ---- neighbour graphs ----


def plain_neighbours(rows, queries, k):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    held = {(i, tuple(v)) for i, v, _ in rows if i is not None and ok(v)}
    scored = {}
    for q, v in {(i, tuple(v)) for i, v, _ in queries if i is not None and ok(v)}:
        scored.setdefault(q, set()).update((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in held if i != q and len(w) == len(v))
    return {q: sorted(s)[:k] for q, s in scored.items()}


@pytest.mark.parametrize("shard_rows", [10_000, 60])
def test_neighbours_against_brute_force(spark, shard_rows):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in awkward_vectors()]
    rows = [(i, [x * (1 + (i or 0) % 5) for x in v] if v and None not in v and i is not None and i < 300 else v, l) for i, v, l in rows]  # lengths differ
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]
    asked = [r for r in rows if r[0] is None or r[0] % 5 == 0]
    got = NeighbourGraph(shard_rows=shard_rows, query_block=40).search(vectors(spark, asked), vectors(spark, rows)).collect()
    want = plain_neighbours(rows, asked, 20)
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    assert set(by) == {q for q, s in want.items() if s}
    hits = total = 0
    exact = {i: np.float64(v) for i, v, _ in rows if v and i is not None and i != 4 and None not in v}
    for q, found in by.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1)) and all(v != q for _, v, _ in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        for _, v, s in found:
            if v != 4 and q != 4:
                assert s == pytest.approx(float(exact[q] @ exact[v]), rel=1e-12, abs=1e-12)
        worst = -want[q][-1][0]
        hits, total = hits + sum(s >= worst - 1e-9 for _, _, s in found), total + len(want[q])
    assert hits / total >= 0.95
    assert NeighbourGraph().search(vectors(spark, []), vectors(spark, rows)).count() == 0
    assert NeighbourGraph().search(vectors(spark, asked), vectors(spark, [])).count() == 0
    one = NeighbourGraph().search(vectors(spark, rows[:1]), vectors(spark, rows[:2])).collect()
    assert [(r.query_id, r.vec_id) for r in one] == [(0, 1)]


def test_graph_recall_and_shape():
    x = np.random.default_rng(2).standard_normal((3000, 24))
    x = np.concatenate([x, x[0] + 1e-3 * np.random.default_rng(3).standard_normal((600, 24))])  # a crowd of near copies
    graph, order = Graph.build(_lifted(x).astype(np.float32), wide=96)
    assert sorted(order) == list(range(len(x)))
    for layer, links in enumerate(graph.layers):
        assert links.shape[1] == (32 if layer == 0 else 16)
        for row in links:
            kept = row[row >= 0]
            assert len(set(kept)) == len(kept) and (kept < len(links)).all()
    q = np.concatenate([x[::30], np.zeros((len(x[::30]), 1))], axis=1).astype(np.float32)
    found = graph.search(q, 192)
    truth = np.argsort(-(x[::30] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(order[f[f >= 0]][:20]) & set(t)) / 20 for f, t in zip(found, truth)]) >= 0.9


def test_the_query_reaches_its_recall(spark):
    got = op12_neighbour_graph(spark, SF).toPandas()
    table = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    x = np.array(table.embedding.tolist(), float)
    hits = 0
    for q, g in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -math.inf
        hits += len(set(g.vec_id) & set(np.lexsort((table.vec_id, -score))[:20]))
    assert hits >= 0.95 * 20 * len(table[table.vec_id % 20 == 0])


# ---- ranked search ----


def plain_ranking(items, docs, k=20):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, split(t)) for i, t in docs]
    held = [(i, Counter(w), len(w)) for i, w in held if w]
    n, total = len(held), sum(s for _, _, s in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, []).extend(split(t))
    out = []
    for item, words in asked.items():
        scored = []
        for d, counts, size in held:
            if d is not None:
                m = 75 + (25 * size * n) // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * counts[w]) // (1000 * counts[w] + 12 * m)) for w in words if w in counts)
                if s:
                    scored.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def lexical_tables(spark, items, docs):
    clash = [(i, t, 1, "x", 2, 3.0) for i, t in docs]
    return spark.createDataFrame([(i, t, 9, 9) for i, t in items], "item_id long, text string, row long, n int"), spark.createDataFrame(clash, "doc_id long, text string, n long, term string, row int, score double")


@pytest.mark.parametrize("settings", [{}, {"seeds": 1, "tried": 20, "buckets": 3}, {"seeds": 10**9, "k": 3}])
def test_ranking_against_plain_python(spark, settings, monkeypatch):
    monkeypatch.setattr("fathomline.llm.ranked_search.BUCKET_ROWS", 50)  # frequent terms are dealt out
    r = random.Random(8)
    common, rare = ["the", "of", "é", "数据"], [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(n))
    docs = [(i, text(r.randint(1, 60))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)]  # copies tie
    docs += [(2000, None), (2001, ""), (2002, " .,;\x7f "), (None, text(30)), (2003, "The THE the É é ÀB_ab-ab"), (7, text(20)), (7, text(20)), (2004, text(20_000)), (2005, "x" * 100_000)]
    items = [(i, text(25)) for i in range(12)] + [(20, docs[3][1]), (21, "the the the"), (22, "unknown words"), (23, None), (24, ""), (None, "the"), (25, "w1 w2"), (25, "w3 the"), (26, "X" * 100_000), (27, "É é AB")]
    got = RankedSearch(**settings).search(*lexical_tables(spark, items, docs)).collect()
    assert sorted(map(tuple, got)) == plain_ranking(items, docs, settings.get("k", 20))
    for a, b in (([], docs), (items, []), (items, [(1, None)])):
        assert RankedSearch().search(*lexical_tables(spark, a, b)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("postings_")]


def test_more_terms_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr("fathomline.llm.ranked_search.SENT_TERMS", 2)
    items, docs = [(1, "a b c d"), (2, "b e")], [(1, "a b"), (2, "b c d"), (3, "x y"), (4, "e b b")]
    assert sorted(map(tuple, RankedSearch().search(*lexical_tables(spark, items, docs)).collect())) == plain_ranking(items, docs)


def test_terms():
    assert terms_of("Ab-c_9É ß\x7f数, x".encode()) == [t.encode() for t in ("ab", "c", "9É ß", "数", "x")]


def test_ranking_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert sorted(map(tuple, op13_ranked_search(spark, SF).collect())) == sorted(con.sql(OP13_SQL).fetchall())
