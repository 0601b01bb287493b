"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors of like bytes are one node with their smallest ids, so that a group of
copies is no clique in a graph. Nodes are dealt to shards of a bounded number by
hash. A shard's graph is built in one task and stored as one row of flat arrays:
for every layer the neighbours of each of its nodes, side by side. Each block of
queries is broadcast and searched in every shard; the shards' lists are merged.

Nearest is the largest inner product. A graph needs a metric, so every node gets
one more component, ``sqrt(longest^2 - |x|^2)``: all nodes of a shard then have
the same length, and the order by distance from ``(q, 0)`` is the order by inner
product.

Nodes are inserted in batches: a batch searches the graph of all before it, and
its members see each other besides. Searches of a batch go on in step, each
expanding its few best open candidates at once as one array operation. As in the
published algorithm, neighbours are the candidates that are nearer to the node
than to any neighbour chosen before, then the nearest others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Scratch

#: Nodes inserted, or queries searched, as one set of arrays.
BATCH = 256
#: Candidates that a search expands in one step.
STEP = 4


class Graph:
    """One shard's graph over the rows of ``x``; ``layers`` holds per layer the nodes and their neighbours, ``-1`` for none.

    Nodes are numbered from the highest layer down, so layer ``l`` has the nodes ``0 .. sizes[l] - 1``.
    """

    def __init__(self, x: np.ndarray, m: int, layers: list[np.ndarray]):
        self.x, self.m, self.layers = x, m, layers

    @classmethod
    def build(cls, x: np.ndarray, m: int = 16, wide: int = 64, seed: int = 1) -> tuple[Graph, np.ndarray]:
        """The graph and the order in which it holds the rows."""
        height = (np.random.default_rng(seed).exponential(1 / math.log(m), len(x))).astype(int)
        order = np.argsort(-height, kind="stable")
        sizes = [int((height >= layer).sum()) for layer in range(int(height.max(initial=0)) + 1)]
        graph = cls(x[order], m, [np.full((n, m if layer else 2 * m), -1, np.int32) for layer, n in enumerate(sizes)])
        for start in range(0, len(x), BATCH):
            graph._insert(start, min(start + BATCH, len(x)), sizes, wide)
        return graph, order

    def _insert(self, start: int, stop: int, sizes: list[int], wide: int) -> None:
        """Nodes ``start .. stop - 1``; those before are in. Entries come down from layer to layer."""
        entry = np.zeros((stop - start, 1), np.int64)
        for layer in range(len(sizes) - 1, -1, -1):
            last = min(stop, sizes[layer])
            new = np.arange(start, max(start, last))
            searched = self._beam(self.layers[layer], self.x[start:stop], entry, wide if len(new) else 1, start)[0] if start else np.full((stop - start, 1), -1)
            if start:
                entry = searched
            if len(new):
                self._link(layer, new, searched[: len(new)])

    def _link(self, layer: int, new: np.ndarray, found: np.ndarray) -> None:
        links = self.layers[layer]
        # The batch's own members are candidates too.
        near = -self.x[new] @ self.x[new].T
        np.fill_diagonal(near, math.inf)
        few = min(self.m, len(new) - 1)
        own = new[np.argpartition(near, few - 1, axis=1)[:, :few]] if few else np.zeros((len(new), 0), np.int64)
        links[new, : self.m] = self._choose(new, np.concatenate([found, own], axis=1), self.m)
        # The other way round: whoever was chosen gets the new node, and chooses anew where it has no room.
        a, b = np.repeat(new, self.m), links[new, : self.m].ravel()
        a, b = a[b >= 0], b[b >= 0]
        by = np.argsort(b, kind="stable")
        nodes, firsts, counts = np.unique(b[by], return_index=True, return_counts=True)
        width = links.shape[1]
        for at in range(0, len(nodes), 512):
            some, count, first = nodes[at : at + 512], counts[at : at + 512], firsts[at : at + 512]
            more = np.full((len(some), int(count.max())), -1, np.int64)
            spot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            more[np.repeat(np.arange(len(some)), count), spot] = a[by][np.repeat(first, count) + spot]
            both = np.concatenate([links[some], more], axis=1)
            full = (both >= 0).sum(axis=1) > width
            room = np.sort(both[~full], axis=1)[:, ::-1][:, :width]
            links[some[~full]] = self._unique(room)
            if full.any():
                links[some[full]] = self._choose(some[full], both[full], width)

    @staticmethod
    def _unique(sorted_rows: np.ndarray) -> np.ndarray:
        """Repeats in descending rows become ``-1``."""
        out = sorted_rows.copy()
        out[:, 1:][sorted_rows[:, 1:] == sorted_rows[:, :-1]] = -1
        return out

    def _choose(self, nodes: np.ndarray, candidates: np.ndarray, count: int) -> np.ndarray:
        """Up to ``count`` neighbours of each node: first those nearer to it than to any chosen one, then the nearest others."""
        candidates = self._unique(np.sort(candidates, axis=1)[:, ::-1])
        candidates[candidates == nodes[:, None]] = -1
        out = np.full((len(nodes), count), -1, np.int64)
        for at in range(0, len(nodes), BATCH):
            ids, some = candidates[at : at + BATCH], nodes[at : at + BATCH]
            dots = np.einsum("bcd,bd->bc", self.x[ids], self.x[some])
            dots[ids < 0] = -math.inf
            order = np.argsort(-dots, axis=1, kind="stable")
            order = order[:, : max(3 * count, count + 16)]
            ids, dots = np.take_along_axis(ids, order, 1), np.take_along_axis(dots, order, 1)
            points = self.x[ids]
            between = points @ points.transpose(0, 2, 1)
            # All lie on one sphere: the larger inner product is the smaller distance.
            closest, chosen = np.full(ids.shape, -math.inf), np.zeros(ids.shape, bool)
            taken = np.zeros(len(ids), int)
            for c in range(ids.shape[1]):
                take = (ids[:, c] >= 0) & (dots[:, c] > closest[:, c]) & (taken < count)
                chosen[:, c] = take
                taken += take
                np.maximum(closest, np.where(take[:, None], between[:, c], -math.inf), out=closest)
            # The chosen in order, then the others in order.
            place = np.argsort(~chosen * 2 + (ids < 0), axis=1, kind="stable")[:, :count]
            picked = np.take_along_axis(ids, place, 1)
            out[at : at + BATCH, : picked.shape[1]] = picked
        return out

    def _beam(self, links: np.ndarray, q: np.ndarray, entry: np.ndarray, wide: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``wide`` best nodes found from its entries, best first, and their inner products; ``-1`` for none."""
        rows = len(q)
        line = np.arange(rows)[:, None]
        seen, writer = np.zeros((rows, n), bool), np.zeros((rows, n), np.int32)
        ids, dots, open_ = np.full((rows, wide), -1, np.int64), np.full((rows, wide), -math.inf, q.dtype), np.zeros((rows, wide), bool)
        fresh = entry
        live = np.arange(rows)
        while True:
            # Each node that a query meets for the first time, once.
            met = fresh >= 0
            r, c = np.nonzero(met)
            v = fresh[r, c]
            keep = ~seen[live[r], v]
            r, c, v = r[keep], c[keep], v[keep]
            writer[live[r], v] = c
            keep = writer[live[r], v] == c
            r, c, v = r[keep], c[keep], v[keep]
            seen[live[r], v] = True
            found = np.full(fresh.shape, -math.inf, q.dtype)
            found[r, c] = np.einsum("nd,nd->n", self.x[v], q[live[r]])
            every = np.concatenate([dots[live], found], axis=1)
            names = np.concatenate([ids[live], np.where(np.isfinite(found), fresh, -1)], axis=1)
            state = np.concatenate([open_[live], np.isfinite(found)], axis=1)
            best = np.argpartition(-every, wide - 1, axis=1)[:, :wide] if every.shape[1] > wide else np.tile(np.arange(wide), (len(live), 1))
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(every, best, 1), axis=1, kind="stable"), 1)
            dots[live], ids[live], state = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1), np.take_along_axis(state, best, 1)
            # The best open candidates are expanded next.
            turn = state & (np.cumsum(state, axis=1) <= STEP)
            open_[live] = state & ~turn
            going = turn.any(axis=1)
            live, turn = live[going], turn[going]
            if not len(live):
                return ids, dots
            at, spot = np.nonzero(turn)
            nth = np.cumsum(turn, axis=1)[at, spot] - 1
            fresh = np.full((len(live), STEP, links.shape[1]), -1, np.int64)
            fresh[at, nth] = links[ids[live[at], spot]]
            fresh = fresh.reshape(len(live), -1)

    def search(self, q: np.ndarray, wide: int) -> np.ndarray:
        """Up to ``wide`` nodes for each query, best first; ``-1`` for none."""
        out = np.full((len(q), wide), -1, np.int64)
        for at in range(0, len(q), BATCH):
            some = q[at : at + BATCH]
            entry = np.zeros((len(some), 1), np.int64)
            for links in self.layers[:0:-1]:
                entry = self._beam(links, some, entry, 1, len(links))[0]
            out[at : at + BATCH] = self._beam(self.layers[0], some, entry, wide, len(self.x))[0]
        return out


_GRAPH = "shard int, dim int, m int, sizes array<int>, neighbours array<int>, vectors array<double>, counts array<int>, members array<long>"


def _lifted(x: np.ndarray) -> np.ndarray:
    """One more component, with which all vectors are of the same length."""
    square = (x * x).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(square.max(initial=0.0) - square, 0))[:, None]], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _builder(m: int, wide: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda name: table.column(name).combine_chunks() if table.num_rows else None
        members = column("ids")
        x = _matrix(column("v"))
        # Inner products are compared relative to the longest vector, so that no square leaves the range.
        scale = np.abs(x).max()
        graph, order = Graph.build(_lifted(x / scale).astype(np.float32), m, wide)
        lists = members.take(pa.array(order))
        row = {
            "shard": [table.column("shard")[0].as_py()], "dim": [x.shape[1]], "m": [m], "sizes": [[len(a) for a in graph.layers]], "neighbours": [np.concatenate([a.ravel() for a in graph.layers])],
            "vectors": [x[order].ravel()], "counts": [lists.value_lengths().to_numpy()], "members": [lists.flatten().to_numpy()],
        }
        types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.table([pa.array(v, t) for v, t in zip(row.values(), types)], names=list(row))

    return run


def _answered(sent, k: int, wide: int):
    """Each shard's graph is read back and searched for all broadcast queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = sent.value
        for batch in batches:
            for at in range(batch.num_rows):
                flat = {c: batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in ("sizes", "neighbours", "vectors", "counts", "members")}
                dim, m = batch.column("dim")[at].as_py(), batch.column("m")[at].as_py()
                if dim not in asked:
                    continue
                x = flat["vectors"].reshape(-1, dim)
                widths = [m if layer else 2 * m for layer in range(len(flat["sizes"]))]
                ends = np.cumsum([n * w for n, w in zip(flat["sizes"], widths)])
                layers = [flat["neighbours"][end - n * w : end].reshape(n, w) for end, n, w in zip(ends, flat["sizes"], widths)]
                graph = Graph(_lifted(x / np.abs(x).max()).astype(np.float32), m, layers)
                ids, q = names[dim], asked[dim]
                unit = q / np.abs(q).max(axis=1, keepdims=True)
                found = graph.search(np.concatenate([unit, np.zeros((len(q), 1))], axis=1).astype(np.float32), wide)
                r, c = np.nonzero(found >= 0)
                nodes = found[r, c]
                score = np.einsum("nd,nd->n", q[r], x[nodes])
                # Each node's members, but the query itself; a row more than are asked for covers that.
                per = flat["counts"][nodes]
                starts = (np.cumsum(flat["counts"]) - flat["counts"])[nodes]
                spot = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                r, vec, score = np.repeat(r, per), flat["members"][np.repeat(starts, per) + spot], np.repeat(score, per)
                other = vec != ids[r]
                r, vec, score = r[other], vec[other], score[other]
                order = np.lexsort((vec, -score, r))
                r, vec, score = r[order], vec[order], score[order]
                first = np.searchsorted(r, r)
                top = np.arange(len(r)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(ids[r[top]]), pa.array(vec[top]), pa.array(score[top])], names=["query_id", "vec_id", "score"])

    return run


class NeighbourGraph:
    """``search(queries, vectors)`` returns ``query_id, rank, vec_id, score``: each query's ``k`` nearest found, by inner product.

    ``index`` builds and writes the shards' graphs; ``search`` builds them too,
    unless it gets them. Scores are exact, in double precision, on the vectors
    as they are; ties go to the smaller id. What is approximate is which
    neighbours are found: ``wide`` is the number of candidates that a search
    keeps, ``m`` the neighbours of a node (twice as many in the lowest layer),
    and ``building`` the candidates when a node is linked.

    Defined cases: vectors that are null, empty, zero, or hold null or
    non-finite components take no part, as candidates or as queries; nor do
    null ids. Vectors of different lengths are no candidates for each other.
    Repeated rows count once; an id with several vectors is a candidate by each
    of them and may be returned for each, and as a query is asked with each.
    A query's own id is no candidate for it. Of equal vectors the ``k + 1``
    smallest ids can be returned, and more never are. Empty tables give no rows.
    Other columns are not read.
    """

    def __init__(self, k: int = 20, m: int = 16, building: int = 96, wide: int = 192, shard_rows: int = 16_384, query_block: int = 16_384):
        self.k, self.m, self.building, self.wide, self.shard_rows, self.query_block = k, m, building, max(wide, k + 1), shard_rows, query_block

    @staticmethod
    def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        """``id, v`` in double precision."""
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
        fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)) & F.exists("v", lambda c: c != 0)
        # -0.0 and 0.0 are one component.
        return rows.where("id is not null").where(F.coalesce(fine, F.lit(False))).select("id", F.transform("v", lambda c: c.cast("double") + F.lit(0.0)).alias("v"))

    def index(self, vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """The shards' graphs, one row of flat arrays each, written."""
        rows = scratch.save(self._usable(vectors, id_col, vec_col).withColumn("mark", F.xxhash64("v")))
        # Copies are one node with their smallest ids; of a large group each task first keeps its own smallest.
        first = F.dense_rank().over(Window.partitionBy("mark", "v").orderBy("id"))
        nodes = rows.withColumn("nth", first).where(F.col("nth") <= self.k + 1).groupBy("mark", "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        nodes = scratch.save(nodes)
        shards = max(1, math.ceil(nodes.count() / self.shard_rows))
        placed = nodes.select(F.pmod(F.col("mark"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "v", "ids")
        # Ranges of shard numbers: a task for each shard, however small the rows are.
        placed = placed.repartitionByRange(shards, "shard")
        graphs = scratch.save(placed.groupBy("shard", "dim").applyInArrow(_builder(self.m, self.building), _GRAPH))
        scratch.drop(rows, nodes)
        return graphs

    def search(self, queries: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", graphs: DataFrame | None = None) -> DataFrame:
        spark = vectors.sparkSession
        scratch = Scratch(spark, "neighbour-graph")
        graphs = self.index(vectors, scratch, id_col, vec_col) if graphs is None else graphs
        shards = max(1, graphs.count())
        asked = scratch.save(self._usable(queries, id_col, vec_col).distinct())
        blocks = max(1, math.ceil(asked.count() / self.query_block))
        parts = []
        for block in range(blocks):
            sent = self._sent(asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block))
            found = graphs.repartitionByRange(shards, "shard").mapInArrow(_answered(sent, self.k, self.wide), "query_id long, vec_id long, score double")
            parts.append(scratch.save(found))
            sent.destroy()
        found = parts[0]
        for part in parts[1:]:
            found = found.union(part)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.distinct().withColumn("rank", rank).where(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")

    @staticmethod
    def _sent(queries: DataFrame):
        """A block of queries, broadcast: ids and vectors by the vectors' length."""
        rows = queries.toArrow().combine_chunks()
        if not rows.num_rows:
            return queries.sparkSession.sparkContext.broadcast(({}, {}))
        ids, v = rows.column("id").combine_chunks(), rows.column("v").combine_chunks()
        lengths = v.value_lengths().to_numpy()
        pick = {int(d): pa.array(np.flatnonzero(lengths == d)) for d in np.unique(lengths)}
        return queries.sparkSession.sparkContext.broadcast(({d: ids.take(at).to_numpy() for d, at in pick.items()}, {d: _matrix(v.take(at)) for d, at in pick.items()}))
