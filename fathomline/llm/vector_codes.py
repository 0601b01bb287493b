"""Vector code compression: short codes from one codebook for each part of the vectors.

Vectors are made whole numbers, cut into equal parts, and each part is written
as the index of its nearest codebook entry. All arithmetic is exact, so codes
don't depend on how the rows are dealt out.

The nearest entry is found by annular norm pruning. Entries are sorted by norm.
As ``|x - e| >= ||x| - |e||``, only entries whose norm lies within the distance
of the best entry so far of the part's own norm can be as near. That interval
is found by binary search, starting from the entry of the closest norm, and its
entries, both ends included, are evaluated exactly.

A round sends the codebooks to the tasks (``parts * entries`` short vectors,
whatever the table), sums what each task assigns, and brings back one row for
each entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

#: Scaled components must stay below this, so that squares and their sums fit into 64 bits.
LARGEST = 1 << 27


class Codebook:
    """The entries of one part, sorted by norm: ``entries`` has a row of whole numbers for each."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norms = np.sqrt((entries.astype(float) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.sorted, self.norms = entries[self.order], norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry; ties go to the lower index."""
        norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        # The entry of the closest norm gives the first distance.
        at = np.searchsorted(self.norms, norm)
        left, right = np.maximum(at - 1, 0), np.minimum(at, len(self.norms) - 1)
        start = np.where(np.abs(norm - self.norms[left]) <= np.abs(self.norms[right] - norm), left, right)
        first = ((x - self.sorted[start]) ** 2).sum(axis=1)
        # Roots and norms are doubles: the annulus is widened by more than they can be off, so both its ends are inside.
        reach = np.sqrt(first.astype(float))
        reach += 1e-9 * (1.0 + reach + norm)
        low = np.searchsorted(self.norms, norm - reach, side="left")
        high = np.searchsorted(self.norms, norm + reach, side="right")
        best, index = first, self.order[start]
        for place in range(len(self.sorted)):
            inside = np.flatnonzero((low <= place) & (place < high))
            distance = ((x[inside] - self.sorted[place]) ** 2).sum(axis=1)
            number = self.order[place]
            better = (distance < best[inside]) | ((distance == best[inside]) & (number < index[inside]))
            best[inside[better]] = distance[better]
            index[inside[better]] = number
        return index, best


def _whole(vectors: pa.Array) -> np.ndarray:
    """A row of whole numbers for each vector; all have one length."""
    n = len(vectors)
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(n, -1)


def _assigned(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and squared distances, a column for each part."""
    pieces = np.split(x, len(books), axis=1)
    found = [book.nearest(piece) for book, piece in zip(books, pieces)]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


class VectorCodes:
    """``encode(vectors)`` returns ``vec_id, code, error, label_error, codebooks_sha256``, one row for each coded row.

    ``code`` has two hex digits for each part's entry, ``error`` is the squared
    distance summed over the parts, ``label_error`` the sum of the errors of all
    rows of the same label. ``codebooks`` returns the entries alone, as an array
    of parts, entries and components, and ``decode`` turns codes back into
    vectors.

    Defined cases: vectors that are null, or hold null or non-finite
    components, are left out. So are empty ones and those that can't be cut
    into the same parts as the others: all must have the length of the first
    vector, by id, whose length is a multiple of ``parts``. With fewer rows
    than ``entries`` a codebook has as many entries as there are rows. Rows
    that share an id are each coded; among the first entries those stand in
    the order of their vectors. Rows with a null id are coded too and stand
    last. Null labels count as one label; without a label column all rows do.
    A component beyond ``LARGEST / scale`` is an error, since its squares don't
    fit into a long. An empty table gives no rows. Other columns are not read.
    """

    def __init__(self, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096):
        if entries > 256:
            raise ValueError("an entry's index has two hex digits")
        self.parts, self.entries, self.rounds, self.scale = parts, entries, rounds, scale

    def _rows(self, vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None) -> DataFrame:
        """``vec_id, label, x`` of all finite vectors that can be cut, written by the caller."""
        label = F.col(label_col) if label_col and label_col in vectors.columns else F.lit(None).cast("int")
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vec_col).alias("v"))
        finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
        number = lambda c: F.when(F.abs(c.cast("double") * self.scale) < LARGEST, F.floor(c.cast("double") * self.scale)).otherwise(
            F.raise_error(F.lit(f"a component is too large: {self.scale} times it must stay below {LARGEST}")).cast("long"))
        return rows.where(F.coalesce(finite, F.lit(False)) & (F.size("v") > 0) & (F.size("v") % self.parts == 0)).select("vec_id", "label", F.transform("v", number).alias("x"))

    def _first(self, rows: DataFrame) -> np.ndarray:
        """The first vectors by id, as a matrix; ``entries`` rows at most reach the driver."""
        # A null id, an id's other vectors: defined above.
        order = [F.asc_nulls_last("vec_id"), F.asc("x")]
        head = rows.orderBy(*order).select(F.size("x").alias("d")).limit(1).collect()
        if not head:
            return np.zeros((0, 0), np.int64)
        like = rows.where(F.size("x") == head[0].d)
        return np.array([r.x for r in like.orderBy(*order).select("x").limit(self.entries).collect()], np.int64)

    def _sums(self, rows: DataFrame, books: np.ndarray) -> np.ndarray:
        """The next round's entries: one row for each entry comes back, of counts and exact sums."""
        parts, entries, width = books.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [Codebook(b) for b in books]
            total = np.zeros((parts * entries, width + 1), np.int64)
            for batch in batches:
                x = _whole(batch.column("x"))
                index, _ = _assigned(x, held)
                flat = (index + np.arange(parts) * entries).ravel()
                np.add.at(total, flat, np.concatenate([x.reshape(-1, width), np.ones((len(flat), 1), np.int64)], axis=1))
            used = np.flatnonzero(total[:, -1])
            columns = [pa.array(used), *(pa.array(total[used, j]) for j in range(width + 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["entry", *(f"s{j}" for j in range(width + 1))])

        names = [f"s{j}" for j in range(width + 1)]
        summed = rows.select("x").mapInArrow(run, ", ".join(["entry long", *(f"{c} long" for c in names)]))
        new = books.reshape(-1, width).copy()
        for row in summed.groupBy("entry").agg(*[F.sum(c).alias(c) for c in names]).collect():  # parts * entries rows at most
            new[row.entry] = [row[c] // row[names[-1]] for c in names[:-1]]
        return new.reshape(books.shape)

    def _fitted(self, rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
        first = self._first(rows)
        if not len(first):
            return rows, np.zeros((self.parts, 0, 0), np.int64)
        rows = rows.where(F.size("x") == first.shape[1])
        books = np.stack(np.split(first, self.parts, axis=1))
        for _ in range(self.rounds):
            books = self._sums(rows, books)
        return rows, books

    def codebooks(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
        scratch = Scratch(vectors.sparkSession, "vector-codes")
        rows = scratch.save(self._rows(vectors, id_col, vec_col, None))
        books = self._fitted(rows)[1]
        scratch.keep()
        return books

    @staticmethod
    def digest(books: np.ndarray) -> str:
        return hashlib.sha256(",".join(str(c) for c in books.ravel().tolist()).encode()).hexdigest()

    @staticmethod
    def decode(codes: pa.Array, books: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for, as whole numbers."""
        index = np.array([list(bytes.fromhex(c)) for c in codes.to_pylist()], np.int64).reshape(-1, len(books))
        return np.concatenate([books[p][index[:, p]] for p in range(len(books))], axis=1)

    def encode(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
        scratch = Scratch(vectors.sparkSession, "vector-codes")
        rows, books = self._fitted(scratch.save(self._rows(vectors, id_col, vec_col, label_col)))
        label = dict(rows.dtypes)["label"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [Codebook(b) for b in books]
            for batch in batches:
                if not batch.num_rows:
                    continue
                index, distance = _assigned(_whole(batch.column("x")), held)
                text = index.astype(np.uint8).tobytes().hex()
                step = 2 * index.shape[1]
                codes = pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(distance.sum(axis=1))], names=["vec_id", "label", "code", "error"])

        coded = scratch.save(rows.mapInArrow(run, f"vec_id long, label {label}, code string, error long"))
        sums = scratch.save(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
        scratch.keep(coded, sums)
        joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
        return joined.select("vec_id", "code", "error", "label_error", F.lit(self.digest(books)).alias("codebooks_sha256"))
