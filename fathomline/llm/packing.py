"""Packing tokenised documents into as few fixed-size sequences as possible.

Documents are tokenised where they lie. Only the count of pieces per length
(at most ``capacity`` numbers, whatever the corpus) reaches the driver, where
the bin-packing problem is solved on counts:

* *Dominance reduction.* For the largest length left, the small set of other
  lengths is found that provably dominates every other way to fill its
  sequence (Martello and Toth's criterion: every feasible set can be split so
  that each part fits under a distinct member of the dominating set). Such
  sequences are fixed, for all pieces of that length at once, and the instance
  shrinks.
* *Best fit.* The rest is packed by best-fit decreasing on counts.

The result is a table of patterns: which ranks of which length go to which
sequences, at what offset. Pieces are ranked within their length by two-level
counting, so no length, however frequent, is gathered in one task, and the
pattern table is joined back to the pieces.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytetext as B
from .storage import Scratch

#: Ids of distinct chunks that a worker remembers before it starts anew.
CACHE_IDS = 6_000_000
#: 1: ASCII letters, 2: ASCII marks, 0: all else.
_KIND = np.array([1 if chr(c).isalpha() and c < 128 else 2 if 0x20 < c < 0x7F and not chr(c).isalnum() else 0 for c in range(256)], np.uint8)


def _chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a text may be cut without changing its byte-level BPE ids.

    A single space or line feed between two visible characters always begins a
    new pre-token; a line feed also ends one, and so does an ASCII letter before
    a mark. Next to other than Latin letters no cut is made at white space,
    since such characters may be white space too.
    """
    visible = data > 0x20
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    before = visible & ((data < 0x7F) | ((data >= 0x80) & (data < 0xC0) & latin))
    after = visible & (data != 0x7F) & ((data < 0x80) | ((data >= 0xC3) & (data <= 0xDF)) | (data >= 0xE4))
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        feed = (data[1:-1] == 0x0A) & before[:-2] & after[2:]
        cut[1:-1] = ((data[1:-1] == 0x20) & before[:-2] & after[2:]) | feed
        cut[2:] |= feed
    kind = _KIND[data]
    cut[1:] |= (kind[:-1] == 1) & (kind[1:] == 2)
    edges = offsets[offsets < len(data)]
    cut[edges] = True
    return np.flatnonzero(cut)


class _Tokens:
    """Token ids of texts, tokenising each distinct chunk of a task once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = B.buffer(texts)
        starts = _chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        h = B.span_hashes(data, starts, ends)
        uniq, where, which = np.unique(h, return_index=True, return_inverse=True)
        fresh = np.flatnonzero(~np.isin(uniq, self.known, assume_unique=True))
        if len(self.ids) > CACHE_IDS:
            self._forget()
            fresh = np.arange(len(uniq))
        if len(fresh):
            raw = data.tobytes()
            chunks = [raw[starts[i] : ends[i]].decode() for i in where[fresh]]
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            self.ids = np.concatenate([self.ids, np.fromiter((i for c in coded for i in c), np.int32, int(sizes.sum()))])
            known = np.concatenate([self.known, uniq[fresh]])
            slot = np.concatenate([self.slot, len(self.at) - 1 + np.arange(len(fresh))])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            order = np.argsort(known, kind="stable")
            self.known, self.slot = known[order], slot[order]
        slots = self.slot[np.searchsorted(self.known, uniq)][which]
        size = self.at[slots + 1] - self.at[slots]
        done = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(done[-1]) - np.repeat(done[:-1] - self.at[slots], size)]
        return ids, done[np.searchsorted(starts, offsets)]


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> _Tokens:
    """One per worker process, which serves many tasks."""
    return _Tokens(path)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for whole in batches:
            for batch in B.passes(whole, "text"):
                ids, at = tokens.encode(batch.column("text"))
                row, piece, start, length, crc, body = [], [], [], [], [], []
                end = np.array([end_id], np.int32)
                for i in range(batch.num_rows):
                    own = np.concatenate([ids[at[i] : at[i + 1]], end]).astype("<u4")
                    cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                    for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i)
                        piece.append(j)
                        start.append(a)
                        length.append(b - a)
                        part = own[a:b]
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            body.append(part.astype(np.int32))
                out = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(body, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def solve(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns ``(lengths in a sequence, how many such sequences)`` that use up all counts."""
    left = {w: c for w, c in counts.items() if c}
    fixed: list[tuple[tuple[int, ...], int]] = []
    lengths = sorted(left)

    def largest(room: int, but: int) -> int:
        """The largest length left that fits; one of ``but`` is already used."""
        i = bisect.bisect_right(lengths, room) - 1
        while i >= 0 and left[lengths[i]] - (lengths[i] == but) <= 0:
            i -= 1
        return lengths[i] if i >= 0 else 0

    def best_two(room: int, but: int, above: int) -> int:
        """The largest sum, within the room, of two pieces left that are both longer than ``above``."""
        i, j, best = bisect.bisect_right(lengths, above), bisect.bisect_right(lengths, room) - 1, 0
        while i <= j and best < room:
            a, b = lengths[i], lengths[j]
            if a + b > room:
                j -= 1
                continue
            if i < j or left[a] - (a == but) >= 2:
                best = max(best, a + b)
            i += 1
        return best

    def three_fit(room: int) -> bool:
        few = [x for x in lengths[:3] for _ in range(min(3, left[x]))][:3]
        return len(few) == 3 and sum(few) <= room

    def dominating(w: int) -> tuple[int, ...]:
        """A set with ``w`` that dominates all others with it, or nothing.

        With one mate: it fills the room, or is at least as long as all that
        any other feasible set puts there. With two, the larger being the
        longest that fits: every feasible set has two members at most, and
        those both longer than the smaller mate fit under the larger one.
        """
        room = capacity - w
        mate = largest(room, w)
        if mate == 0:
            return (w,)
        if mate == room:
            return (w, mate)
        if three_fit(room):
            return ()
        left[mate] -= 1
        second = largest(room - mate, w)
        left[mate] += 1
        if best_two(room, w, second) > mate:
            return ()
        return (w, mate, second) if second else (w, mate)

    for w in sorted(left, reverse=True):
        while left.get(w, 0) > 0 and (chosen := dominating(w)):
            take = min(left[x] // chosen.count(x) for x in set(chosen))
            if take == 0:
                break
            fixed.append((chosen, take))
            for x in set(chosen):
                left[x] -= take * chosen.count(x)
                if not left[x]:
                    del left[x]
                    lengths.remove(x)
    return fixed + _best_fit(left, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: open sequences are groups of equal contents."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((pattern, n))

    for w in sorted(left, reverse=True):
        c = left[w]
        while c:
            i = bisect.bisect_left(rooms, w)
            if i == len(rooms):
                each = capacity // w
                full, rest = divmod(c, each)
                if full:
                    put(capacity - each * w, (w,) * each, full)
                if rest:
                    put(capacity - rest * w, (w,) * rest, 1)
                c = 0
                continue
            room = rooms[i]
            pattern, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            each = min(room // w, c)
            used = min(n, c // each)
            put(room - each * w, pattern + (w,) * each, used)
            if n > used:
                put(room, pattern, n - used)
            c -= used * each
    return [g for gs in groups.values() for g in gs]


class BestFitPacker:
    """Packs all documents; ``pieces`` tokenises and cuts, ``pack`` also places.

    Columns of ``pack``: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``, and ``ids`` if asked for.

    A document is its ids and then ``end_id``. One longer than ``capacity`` is
    cut into pieces of that size, of which the first may be shorter.

    Defined cases: a null or empty text has only ``end_id``. Null and repeated
    ids are packed like others, each row for itself. Very long texts become many
    pieces. An empty table gives no rows. Other columns are not read.
    """

    def __init__(self, tokenizer_path: str, capacity: int = 2048, end_id: int = 0):
        self.tokenizer_path, self.capacity, self.end_id = tokenizer_path, capacity, end_id

    def pieces(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
        schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        return source.mapInArrow(_pieces(self.tokenizer_path, self.capacity, self.end_id, with_ids), schema)

    def pack(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
        scratch = Scratch(docs.sparkSession, "packing")
        cut = scratch.save(
            self.pieces(docs, id_col, text_col, with_ids).withColumn("lot", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
        )
        return self.place(cut).drop("lot", "row")

    def place(self, cut: DataFrame) -> DataFrame:
        """``cut`` has ``length``, and ``lot`` and ``row``: any dealing of the rows into lots and any distinct numbers."""
        spark = cut.sparkSession
        counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most one row for each length
        slots, base = [], 0
        given = dict.fromkeys(counts, 0)
        for pattern, n in solve(counts, self.capacity):
            offset = 0
            for w in dict.fromkeys(pattern):
                each = pattern.count(w)
                slots.append((w, given[w], given[w] + n * each, base, each, offset))
                given[w] += n * each
                offset += each * w
            base += n
        table = spark.createDataFrame(slots, "length long, low long, high long, base long, each long, shift long")
        # Where a length lies in a single slot its rows still need ranks; these are counted lot by lot.
        lots = cut.groupBy("length", "lot").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1))
        lots = lots.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
        rank = F.row_number().over(Window.partitionBy("length", "lot").orderBy("row")) - 1
        ranked = cut.withColumn("in_lot", rank).join(lots, ["length", "lot"]).withColumn("rank", F.col("in_lot") + F.col("before"))
        slot = F.col("rank") - F.col("low")
        return (
            ranked.join(F.broadcast(table), "length")  # a few rows for each length, so bounded by the capacity
            .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
            .withColumn("sequence_id", F.expr("base + (rank - low) div each"))
            .withColumn("offset", F.col("shift") + (slot % F.col("each")) * F.col("length"))
            .drop("in_lot", "before", "rank", "low", "high", "base", "each", "shift")
        )
