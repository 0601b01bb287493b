"""N-best SentencePiece segmentation, and decoding.

No piece of the vocabulary continues past a word start, so a text's piece
lattice is a chain of small lattices, one for each word. In each of these a
forward Viterbi pass gives the best score of every prefix, which is an exact
heuristic for an A-star search backward from the word's end: paths leave the
agenda in the order of their scores. Both run over all new distinct words of a
batch at once, as arrays. A word's alternatives are remembered within a stated
number of bytes, and the text's N best are put together from its words'
alternatives exactly.

The model file is of the BPE kind: what it stores for a piece is not a
log-probability but the piece's place in the order of merges, whose sum would
prefer many short pieces. Scores are therefore those of a unigram model under
Zipf's law, ``-ln(place + SHIFT)``.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B

SPACE = "▁"
_MARK = np.uint32(ord(SPACE))
#: The shift of Zipf's law for the pieces' places.
SHIFT = 100.0
#: An unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Bytes of remembered words, after which a worker starts anew.
CACHE_BYTES = 96 << 20
#: Characters of words that are searched together; it bounds the arrays of a search.
SEARCH_CHARS = 1 << 15
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _spread(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The indexes ``starts[i], starts[i] + 1, ...``, ``sizes[i]`` of each."""
    done = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - done, sizes)


def _utf8(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of each character, four columns of which the first ``size`` count."""
    c = chars.astype(np.int64)
    size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    tail = [0x80 | (c >> s & 0x3F) for s in (0, 6, 12)]
    one, two, three, four = c, 0xC0 | c >> 6, 0xE0 | c >> 12, 0xF0 | c >> 18
    pick = lambda *options: np.choose(size - 1, options)
    return np.column_stack([pick(one, two, three, four), pick(one, tail[0], tail[1], tail[2]), pick(one, one, tail[0], tail[1]), pick(one, one, one, tail[0])]), size


class Pieces:
    """The vocabulary as arrays, and the words searched so far."""

    def __init__(self, model_path: str, n: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.n, self.byte_id, self.pieces = n, np.zeros(256, np.int32), {}
        raw: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"the piece {piece!r} continues past a word start")
                self.pieces[piece] = (i, -math.log(SHIFT - model.get_score(i)))
                raw.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.up, self.down = _powers(_ODD, 1 << 12), _powers(_INVERSE, 1 << 12)
        self._table()
        self._forget()

    def _table(self) -> None:
        """Pieces by hash in an open table: the slot a hash falls on, or one of the next few."""
        listed = list(self.pieces.items())
        chars = np.frombuffer("".join(p for p, _ in listed).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p, _ in listed])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(B.mix(chars.astype(np.uint64) + np.uint64(1)) * self._up(len(chars)))])
        starts = np.concatenate([[0], ends[:-1]])
        keys = (sums[ends] - sums[starts]) * self._down(len(chars))[starts]
        self.bits = 18
        self.probes = 1
        slot_key, slot_id = np.zeros((1 << self.bits) + 64, np.uint64), np.full((1 << self.bits) + 64, -1, np.int32)
        for k, (_, (i, _)) in zip(keys, listed):
            at = start = int(B.mix(np.array([k]))[0] >> np.uint64(64 - self.bits))
            while slot_id[at] >= 0:
                at += 1
            slot_key[at], slot_id[at] = k, i
            self.probes = max(self.probes, at - start + 1)
        self.slot_key, self.slot_id = slot_key, slot_id
        self.score_of = np.full(len(self.raw_at), -math.inf)
        for i, s in self.pieces.values():
            self.score_of[i] = s

    def _up(self, n: int) -> np.ndarray:
        if n > len(self.up):
            self.up = _powers(_ODD, 1 << n.bit_length())
        return self.up[:n]

    def _down(self, n: int) -> np.ndarray:
        if n > len(self.down):
            self.down = _powers(_INVERSE, 1 << n.bit_length())
        return self.down[:n]

    def _look(self, keys: np.ndarray) -> np.ndarray:
        """The ids of the pieces with these hashes, -1 for others."""
        at = (B.mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.where(self.slot_key[at] == keys, self.slot_id[at], np.int32(-1))
        left = np.flatnonzero((found < 0) & (self.slot_id[at] >= 0))
        for step in range(1, self.probes):
            if not len(left):
                break
            there = at[left] + step
            hit = (self.slot_key[there] == keys[left]) & (self.slot_id[there] >= 0)
            found[left[hit]] = self.slot_id[there[hit]]
            left = left[~hit & (self.slot_id[there] >= 0)]
        return found

    def _forget(self) -> None:
        """Word i's r-th best has ``ids[at[i * n + r] : at[i * n + r + 1]]`` and the score ``scores[i, r]``, -inf without one."""
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.ids, self.scores = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros((0, self.n))

    def _lattice(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words as rows of characters, 0 beyond their ends: piece ids and scores of the edges that end at each position, by length, and the best score of each prefix."""
        w, m = chars.shape
        wide = min(self.longest, m)
        sums = np.zeros((w, m + 1), np.uint64)
        np.cumsum(B.mix(chars.astype(np.uint64) + np.uint64(1)) * self._up(m), axis=1, out=sums[:, 1:])
        edge = np.full((w, m + 1, wide + 1), -1, np.int32)
        inside = chars != 0
        for d in range(1, wide + 1):
            r, j = np.nonzero(inside[:, d - 1 :])
            edge[r, j + d, d] = self._look((sums[r, j + d] - sums[r, j]) * self._down(m)[j])
        score = np.where(edge >= 0, self.score_of[edge], -math.inf)
        score[:, :, 1] = np.where(edge[:, :, 1] >= 0, score[:, :, 1], self.unknown)
        best = np.full((w, m + 1), -math.inf)
        best[:, 0] = 0
        for j in range(1, m + 1):
            k = min(j, wide)
            best[:, j] = (best[:, j - k : j][:, ::-1] + score[:, j, 1 : k + 1]).max(axis=1)
        return edge, score, best

    def search(self, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n best paths of each word by A-star from its end: ids, their offsets for each word and rank, and scores.

        An agenda never needs more entries than paths are asked for. Equal
        totals leave it in the order in which they entered, those of shorter
        pieces first.
        """
        n, (w, m) = self.n, chars.shape
        edge, score, best = self._lattice(chars)
        wide = edge.shape[2] - 1
        total, at = np.full((w, n), math.inf), np.zeros((w, n), np.int64)
        behind, node = np.zeros((w, n)), np.full((w, n), -1, np.int64)
        total[:, 0], at[:, 0] = -best[np.arange(w), length], length
        parents, places, sizes, made = [], [], [], 0
        ends, scores, found = np.full((w, n), -1, np.int64), np.full((w, n), -math.inf), np.zeros(w, np.int64)
        live = np.arange(w)
        while len(live):
            here, gone, tip = at[live, 0], behind[live, 0], node[live, 0]
            done = here == 0
            if done.any():
                rows = live[done]
                ends[rows, found[rows]], scores[rows, found[rows]] = tip[done], gone[done]
                found[rows] += 1
            # What the popped entry leads to, after what else is on the agenda.
            steps = here[:, None] - np.arange(1, wide + 1)
            ahead = gone[:, None] + score[live, here, 1:]
            fresh = np.where((steps >= 0) & ~done[:, None], -(ahead + best[live[:, None], np.maximum(steps, 0)]), math.inf)
            every = np.concatenate([total[live, 1:], fresh], axis=1)
            row = np.arange(len(live))
            new = [np.empty((len(live), n)), np.empty((len(live), n), np.int64), np.empty((len(live), n)), np.empty((len(live), n), np.int64)]
            for r in range(n):
                c = every.argmin(axis=1)
                value = every[row, c]
                every[row, c] = math.inf
                old, d = c < n - 1, np.maximum(c - (n - 1), 0)
                kept = np.minimum(c + 1, n - 1)
                new[0][:, r], new[1][:, r] = value, np.where(old, at[live, kept], np.maximum(here - d - 1, 0))
                new[2][:, r] = np.where(old, behind[live, kept], ahead[row, d])
                add = ~old & np.isfinite(value)
                ids = np.where(old, node[live, kept], -1)
                ids[add] = made + np.arange(int(add.sum()))
                new[3][:, r] = ids
                parents.append(tip[add])
                places.append(live[add] * (m + 1) + here[add])
                sizes.append(d[add] + 1)
                made += int(add.sum())
            total[live], at[live], behind[live], node[live] = new
            live = live[(found[live] < n) & np.isfinite(total[live, 0])]
        return (*self._paths(ends, np.concatenate(parents), np.concatenate(places), np.concatenate(sizes), edge, chars), scores)

    def _paths(self, ends: np.ndarray, parents: np.ndarray, places: np.ndarray, sizes: np.ndarray, edge: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids along the chains of nodes that start at ``ends``, and the chains' offsets in them."""
        m = chars.shape[1]
        chain, step = np.flatnonzero(ends.ravel() >= 0), 0
        node = ends.ravel()[chain]
        owner, depth, code, char = [], [], [], []
        while len(node):
            r, j = np.divmod(places[node], m + 1)
            owner.append(chain)
            depth.append(np.full(len(chain), step))
            code.append(edge[r, j, sizes[node]])
            char.append(chars[r, j - 1])
            go = parents[node] >= 0
            chain, node, step = chain[go], parents[node[go]], step + 1
        count = ends.size
        if not owner:
            return np.zeros(0, np.int32), np.zeros(count + 1, np.int64)
        owner, depth, code, char = (np.concatenate(x) for x in (owner, depth, code, char))
        order = np.lexsort((depth, owner))
        owner, code, char = owner[order], code[order], char[order]
        size = np.ones(len(code), np.int64)
        missing = code < 0
        if missing.any():
            spelled, long = _utf8(char[missing])
            size[missing] = long
        out = np.repeat(code, size)
        if missing.any():
            out[np.repeat(missing, size)] = self.byte_id[spelled[np.arange(4) < long[:, None]]]
        per = np.bincount(owner, size, count).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(per)])

    def _learn(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Searches new words, of like lengths together, and remembers them."""
        length = ends - starts
        order = np.argsort(length, kind="stable")
        at = 0
        slots, offsets, ids, scores = [], [], [], []
        while at < len(order):
            # As many as fit at the length of the longest among them; one word at least.
            fit = np.searchsorted(length[order[at:]] * np.arange(1, len(order) - at + 1), SEARCH_CHARS, side="right")
            own = order[at : at + max(1, int(fit))]
            at += len(own)
            size = length[own]
            rows = np.zeros((len(own), int(size[-1])), np.uint32)
            rows[np.arange(rows.shape[1]) < size[:, None]] = chars[_spread(size, starts[own])]
            found, cuts, score = self.search(rows, size)
            slots.append(own)
            ids.append(found)
            offsets.append(np.diff(cuts))
            scores.append(score)
        own = np.concatenate(slots)
        base = len(self.scores)
        self.ids = np.concatenate([self.ids, *ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(offsets))])
        self.scores = np.concatenate([self.scores, *scores])
        known, slot = np.concatenate([self.known, keys[own]]), np.concatenate([self.slot, base + np.arange(len(own))])
        order = np.argsort(known, kind="stable")
        self.known, self.slot = known[order], slot[order]

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The slots of the texts' words in order, and each text's offsets in them."""
        data, offsets = B.buffer(texts)
        lead = (data & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(lead)])[offsets]
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        # One mark stands before every text that has any characters.
        first = np.flatnonzero(np.diff(before) > 0)
        chars = np.insert(chars, before[first], np.uint32(0x20))
        chars[chars == 0x20] = _MARK
        bounds = before + np.searchsorted(first, np.arange(len(before)))
        mark = chars == _MARK
        start = mark.copy()
        start[1:] &= ~mark[:-1]
        start[bounds[first]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(chars))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(B.mix(chars.astype(np.uint64) + np.uint64(1)) * self._up(len(chars)))])
        keys = B.mix((sums[ends] - sums[starts]) * self._down(len(chars) + 1)[starts] + (ends - starts).astype(np.uint64) * _ODD)
        uniq, where, which = np.unique(keys, return_index=True, return_inverse=True)
        if self.ids.nbytes + self.at.nbytes + self.scores.nbytes + 2 * self.known.nbytes > CACHE_BYTES:
            self._forget()
        new = np.flatnonzero(~np.isin(uniq, self.known, assume_unique=True))
        if len(new):
            self._learn(chars, starts[where[new]], ends[where[new]], uniq[new])
        slots = self.slot[np.searchsorted(self.known, uniq)][which]
        return slots, np.searchsorted(starts, bounds)

    def encode(self, texts: pa.Array) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For each text its n best ``(score, ids)``, best first."""
        slots, first = self.words(texts)
        n = self.n
        best = slots * n
        size = self.at[best + 1] - self.at[best]
        done = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[_spread(size, self.at[best])]
        top = self.scores[slots]
        gaps = top[:, 0] - top[:, 1] if n > 1 else np.zeros(len(slots))
        for a, b in zip(first, first[1:]):
            own, score = ids[done[a] : done[b]], float(top[a:b, 0].sum())
            found = [(score, own)]
            if n > 1 and b > a:
                # The n best differ from the best only in those words whose second choice costs least.
                where = np.argsort(gaps[a:b], kind="stable")[: n - 1] if b - a <= 64 else self._least(gaps[a:b], n - 1)
                found += self._others(score, own, slots[a:b], done[a : b + 1] - done[a], where)
            yield found

    @staticmethod
    def _least(gaps: np.ndarray, k: int) -> np.ndarray:
        """The first of the least gaps; equal ones by place."""
        edge = np.partition(gaps, k - 1)[k - 1]
        near = np.flatnonzero(gaps <= edge)
        return near[np.argsort(gaps[near], kind="stable")[:k]]

    def _others(self, score: float, ids: np.ndarray, slots: np.ndarray, done: np.ndarray, where: np.ndarray) -> list[tuple[float, np.ndarray]]:
        n = self.n
        choices: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for p in where.tolist():
            own = self.scores[slots[p]]
            more = [(loss + float(own[0] - own[r]), (*c, (p, r))) for loss, c in choices for r in range(1, n) if own[r] > -math.inf]
            choices = sorted(choices + more, key=itemgetter(0))[:n]
        found = []
        for loss, changes in choices[1:]:
            parts, at = [], 0
            for p, r in sorted(changes):
                k = int(slots[p]) * n + r
                parts += [ids[at : done[p]], self.ids[self.at[k] : self.at[k + 1]]]
                at = int(done[p + 1])
            found.append((score - loss, np.concatenate([*parts, ids[at:]])))
        return found

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' pieces together, without the first mark."""
        start = self.raw_at[ids]
        raw = self.raw[_spread(self.raw_at[ids + 1] - start, start)].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


@functools.lru_cache(maxsize=2)
def _pieces(path: str, n: int) -> Pieces:
    """One per worker process, which serves many tasks."""
    return Pieces(path, n)


class NBestPieces:
    """``encode`` returns ``doc_id, rank, score, ids``, ``check`` a digest of it with the decoded text compared, ``decode`` texts of ids.

    Scores are sums of the pieces' scores; ranks run from 1 to ``n``, or to as
    many segmentations as there are.

    Defined cases: a null or empty text has one segmentation, without ids. Null
    and repeated ids are encoded row by row. Characters outside the vocabulary
    become their bytes. Among equal scores the order is that in which the search
    finds them. Ids outside the vocabulary, and nulls among them, fail decoding;
    null ids decode to null, bytes that are no UTF-8 to U+FFFD. A text without
    spaces is one word, whatever its length. An empty table gives no rows. Other
    columns are not read.
    """

    def __init__(self, model_path: str, n: int = 3):
        self.model_path, self.n = model_path, n

    def _run(self, docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
        path, n = self.model_path, self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = _pieces(path, n)
            for whole in batches:
                for batch in B.passes(whole, "text"):
                    data, at = B.buffer(batch.column("text"))
                    rows = []
                    for i, found in enumerate(pieces.encode(batch.column("text"))):
                        own = data[at[i] : at[i + 1]].tobytes() if digest else b""
                        for rank, (score, ids) in enumerate(found, 1):
                            last = (len(ids), zlib.crc32(ids.astype("<u4").tobytes()), pieces.spell(ids) == own) if digest else (ids,)
                            rows.append((i, rank, score, *last))
                    types = [pa.int64(), pa.int32(), pa.float64(), *([pa.int64(), pa.int64(), pa.bool_()] if digest else [pa.list_(pa.int32())])]
                    columns = list(zip(*rows)) or [[]] * len(types)
                    names = ["doc_id", "rank", "score", *(["n_pieces", "ids_crc32", "decoded"] if digest else ["ids"])]
                    arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(arrays[0]), *arrays[1:]], names=names)

        schema = "doc_id long, rank int, score double, " + ("n_pieces long, ids_crc32 long, decoded boolean" if digest else "ids array<int>")
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        return self._run(docs, id_col, text_col, digest=False)

    def check(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        return self._run(docs, id_col, text_col, digest=True)

    def decode(self, coded: DataFrame, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
        path, n = self.model_path, self.n

        def run(ids: pa.Array) -> pa.Array:
            pieces = _pieces(path, n)
            return pa.array([None if i is None else pieces.spell(np.array(i, np.int64)).decode(errors="replace") for i in ids.to_pylist()], pa.string())

        return coded.withColumn(out_col, F.arrow_udf(run, "string")(ids_col))
