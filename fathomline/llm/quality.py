"""Document quality by Bradley-Terry pairwise ranking.

Every text becomes a vector of layout and repetition measures in one pass over
its bytes. Preference pairs join a labelled good document with a labelled bad
one, and every labelled row takes part in them; the Bradley-Terry model, P(winner beats loser) = sigmoid(w.(x_win -
x_lose)), is a logistic regression on feature differences without intercept
and gives each document the strength w.x. Documents are then cut at a quantile
of the strengths.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .labelled import fold, labelled_rows, placed
from .storage import Scratch

FEATURES = (
    "log_bytes", "space", "upper", "digit", "stop_marks", "shout_marks", "bars", "symbols", "other_marks", "non_ascii",
    "log_words", "word_length", "long_words", "caps_words", "marked_words", "word_variety", "repeated_next", "line_length", "line_variety", "title_words",
)

_CLASS = np.full(256, 8, np.uint8)
for _codes, _kind in ((b" \t\n\r\x0b\x0c", 0), (bytes(range(65, 91)), 1), (b"0123456789", 2), (b".,;:'\"-()", 3), (b"!?", 4), (b"|", 5), (b"#$%&*@^~<>{}[]\\/=+_`", 6), (bytes(range(97, 123)), 7)):
    _CLASS[list(_codes)] = _kind
_CLASS[128:] = 9


def _within(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many marks are set between each two bounds."""
    sums = np.concatenate([[0], np.cumsum(marks)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _distinct(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[fresh], minlength=n)[:n]


def layout_features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; a null or empty text has zeros."""
    data, offsets = B.buffer(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    per = np.maximum(size, 1)
    kinds = np.bincount(np.repeat(np.arange(n) * 10, size) + _CLASS[data], minlength=10 * n)[: 10 * n].reshape(n, 10) / per[:, None]
    starts, ends, first = B.word_spans(data, offsets, B.WHITESPACE)
    words = np.diff(first)
    each = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    length = ends - starts
    h = B.span_hashes(B.LOWER[data], starts, ends)
    upper = np.concatenate([[0], np.cumsum(_CLASS[data] == 1)])
    lower = np.concatenate([[0], np.cumsum((_CLASS[data] == 7) | (_CLASS[data] == 9))])
    ups, lows = upper[ends] - upper[starts], lower[ends] - lower[starts]
    last = _CLASS[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    feeds = np.ones(256, bool)
    feeds[0x0A] = False
    line_starts, line_ends, line_first = B.word_spans(data, offsets, ~feeds)
    lines = np.diff(line_first)
    line_owner = np.repeat(np.arange(n), lines)
    line_h = B.span_hashes(data, line_starts, line_ends)
    heads = _CLASS[data[starts]] == 1 if len(starts) else np.zeros(0, bool)
    return np.column_stack([
        np.log1p(size), kinds[:, 0], kinds[:, 1], kinds[:, 2], kinds[:, 3], kinds[:, 4], kinds[:, 5], kinds[:, 6], kinds[:, 8], kinds[:, 9],
        np.log1p(words), np.minimum(size / each, 40) / 10, _within(length > 20, first) / each, _within((ups > 1) & (lows == 0), first) / each,
        _within((last >= 4) & (last <= 6), first) / each, np.log1p(_distinct(h, owner, n)) / np.log1p(each), _within(again, first) / each,
        np.log1p(size / np.maximum(lines, 1)), np.log1p(_distinct(line_h, line_owner, n)) / np.log1p(np.maximum(lines, 1)), _within(heads & (lows > 0), first) / each,
    ])


def feature_column(measure, text: Column) -> Column:
    """The measured features of a text as an array column; texts never leave their partition."""

    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [np.ascontiguousarray(measure(part.column("text")), np.float64) for part in B.passes(batch, "text")]
        x = np.concatenate(parts) if parts else np.zeros((0, 1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    return F.arrow_udf(run, "array<double>")(text.cast("string"))


@dataclass(frozen=True)
class QualityModel:
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    cut: float
    share_cut: float
    slope: float


class QualityClassifier:
    """Scores documents by strength; ``predicted`` is 1 from ``accept`` on.

    ``fit`` learns from all labelled rows outside the held-out fold, from at
    least ``pairs`` preference pairs and ``each`` of every row, as far as there
    are so many. ``score`` returns ``doc_id, held_out, score, predicted, strength``
    for every row of the documents, ``keep`` the documents that aren't rejected.

    Defined cases: a null text counts as empty and is scored like any other. A
    null id is scored and not held out. Repeated rows are each scored. If the
    labelled rows lack one of the two classes there is nothing to compare: all
    documents score ``accept``. An empty table gives no rows. Other columns are
    not read.
    """

    def __init__(self, pairs: int = 40_000, each: int = 2, parts: int = 4, held_out: int = 2, accept: float = 0.7, ridge: float = 1e-3):
        self.pairs, self.each, self.parts, self.held_out, self.accept, self.ridge = pairs, each, parts, held_out, accept, ridge

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
        scratch = Scratch(docs.sparkSession, "quality")
        rows = labelled_rows(labels, "quality", self.parts, self.held_out)
        source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(fold("id", self.parts) != self.held_out)
        # Texts are measured where they are; their features meet the labels.
        known = scratch.save(source.select("id", feature_column(layout_features, F.col("text")).alias("x")).join(rows, "id"))
        k = len(FEATURES)
        seen = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n_good, n_bad = seen.get(1, 0), seen.get(0, 0)
        if not n_good or not n_bad:
            scratch.keep()
            return QualityModel((0.0,) * k, (0.0,) * k, (1.0,) * k, 0.0, 0.0, 1.0)
        about = known.select(Summarizer.metrics("mean", "std").summary(array_to_vector("x")).alias("m")).first().m
        center, scale = about.mean.toArray(), np.maximum(about.std.toArray(), 1e-6)
        told = scratch.save(self._pairs(known, scale, n_good, n_bad))
        fitted = LogisticRegression(fitIntercept=False, standardization=False, regParam=self.ridge, maxIter=50).fit(told.select(array_to_vector("x").alias("features"), "label"))
        w = fitted.coefficients.toArray()
        model = QualityModel(tuple(w.tolist()), tuple(center.tolist()), tuple(scale.tolist()), 0.0, 0.0, 1.0)
        strengths = known.select(self._strength(model).alias("s"), "y").repartitionByRange("s").withColumn("lot", F.spark_partition_id())
        strengths = scratch.save(strengths)
        share, cut = _best_cut(strengths, n_good, n_bad)
        model = replace(model, cut=cut, share_cut=share, slope=_slope(strengths, cut, n_good + n_bad))
        scratch.keep()
        return model

    def _pairs(self, known: DataFrame, scale: np.ndarray, n_good: int, n_bad: int) -> DataFrame:
        """Preference pairs ``x, label``: scaled differences of a good row's features and a bad one's, half of them told the other way round.

        Rows are numbered in the order of lots by hash. Pair ``p`` takes the
        rows ``p`` modulo their classes' sizes, shifted by one whenever these
        have come round together, so that pairs are distinct.
        """
        lots = -(-(n_good + n_bad) // 10_000)
        ranked = placed(known.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(lots))), ["y"], F.xxhash64("id"), "id", "x")
        side = lambda y, name: ranked.where(F.col("y") == y).select(F.col("place").alias(name), F.col("x").alias(f"x_{name}"))
        p, round_ = F.col("id"), math.lcm(n_good, n_bad)
        total = min(max(self.pairs, self.each * max(n_good, n_bad)), n_good * n_bad)
        dealt = known.sparkSession.range(total).select(p, (p % n_good).alias("good"), ((p + F.floor(p / round_)) % n_bad).alias("bad"))
        sign = F.when(F.xxhash64("id") % 2 == 0, 1.0).otherwise(-1.0)
        apart = [(F.get("x_good", F.lit(j)) - F.get("x_bad", F.lit(j))) / float(s) * sign for j, s in enumerate(scale)]
        return dealt.join(side(1, "good"), "good").join(side(0, "bad"), "bad").select(F.array(*apart).alias("x"), (sign > 0).cast("double").alias("label"))

    def _strength(self, model: QualityModel) -> Column:
        return sum((F.get("x", F.lit(j)) - c) / s * w for j, (w, c, s) in enumerate(zip(model.weights, model.center, model.scale)))

    def _score(self, model: QualityModel, strength: Column) -> Column:
        curve = 1 / (1 + F.exp(-(strength - model.cut) * model.slope - math.log(self.accept / (1 - self.accept))))
        return F.when(strength >= model.cut, F.greatest(curve, F.lit(self.accept))).otherwise(F.least(curve, F.lit(math.nextafter(self.accept, 0))))

    def score(self, docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), feature_column(layout_features, F.col(text_col)).alias("x"))
        scored = measured.withColumn("strength", self._strength(model)).withColumn("score", self._score(model, F.col("strength")))
        held_out = F.coalesce(fold("doc_id", self.parts) == self.held_out, F.lit(False)).alias("held_out")
        return scored.select("doc_id", held_out, "score", (F.col("score") >= self.accept).cast("int").alias("predicted"), "strength")

    def keep(self, docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
        """The documents that aren't rejected, with all their columns."""
        measured = docs.select(F.struct("*").alias("d"), feature_column(layout_features, F.col(text_col)).alias("x"))
        return measured.where(self._strength(model) >= model.cut).select("d.*")


def _best_cut(strengths: DataFrame, n_good: int, n_bad: int) -> tuple[float, float]:
    """The share of documents to reject and its quantile: the one with the best mean of both classes' accuracies, amid its plateau.

    ``strengths(s, y, lot)`` lie in lots by ranges of ``s``. The quantiles are
    exact, interpolated between two neighbours in the order of all rows, and all
    rows are counted between them.
    """
    shares = np.linspace(0, 1, 401)
    at = shares * (n_good + n_bad - 1)
    low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
    asked = np.unique(np.concatenate([low, high])).tolist()
    value = {r.place: r.s for r in placed(strengths, [], "s").where(F.col("place").isin(asked)).select("place", "s").collect()}
    a, b = (np.array([value[i] for i in ends]) for ends in (low, high))
    cuts = a + (b - a) * (at - low)
    splits, of = np.unique(cuts, return_inverse=True)
    told = Bucketizer(splits=[-math.inf, *splits.tolist(), math.inf], inputCol="s", outputCol="bucket").transform(strengths)
    below = np.zeros((2, len(splits) + 1))
    for r in told.groupBy("y", "bucket").agg(F.count("*").alias("n")).collect():
        below[r.y, int(r.bucket)] = r.n
    gone = np.cumsum(below, axis=1)[:, of] / np.array([[n_bad], [n_good]])
    both = gone[0] + 1 - gone[1]
    best = np.flatnonzero(both >= both.max() - 1e-9)
    best = best[len(best) // 2]
    return float(shares[best]), float(cuts[best])


def _slope(strengths: DataFrame, cut: float, n: int) -> float:
    """The steepness of the logistic curve through the cut, by logistic regression on one number and a shift."""
    scale = max(strengths.agg(F.stddev_pop("s")).first()[0], 1e-9)
    rows = strengths.select(array_to_vector(F.array((F.col("s") - cut) / scale)).alias("features"), F.col("y").cast("double").alias("label"))
    fitted = LogisticRegression(standardization=False, regParam=1e-2 / n, maxIter=50).fit(rows)
    return max(float(fitted.coefficients[0]), 0.1) / scale
