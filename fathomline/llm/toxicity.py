"""Toxic documents by gradient-boosted trees over dense features.

The features are densities of two lexicons (a short fixed one and one learned
from the labelled sample: words and word beginnings with high log-odds among
toxic documents), the share of their words near a second-person pronoun,
capitals, punctuation, and rates of obfuscated spelling. The trees' margin is
calibrated by isotonic regression on labelled rows that the trees haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .labelled import fold, labelled_sample
from .quality import _within, feature_column
from .storage import Scratch

# Common insults, and second-person pronouns, in the corpus's languages.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers trash scum clown pathetic worthless disgusting garbage imbecile jerk fool filth vermin "
    "dummkopf trottel abschaum arschloch dreckskerl wertlos imbécile crétin abruti connard débile ordure imbécil estúpido estúpida basura escoria inútil"
)
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros"

FEATURES = (
    "log_words", "fixed_hits", "fixed_density", "learned_hits", "learned_density", "learned_weight", "strongest", "plain_spelled", "obfuscated_hits", "near_second_person",
    "second_person", "caps_words", "upper", "shout_marks", "marks", "mixed_words", "split_words", "stretched",
)

#: Lengths in bytes of the word beginnings that the lexicon may hold; 0 stands for the whole word.
STEMS = (0, 5, 7)
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$!", b"oieastasi"):
    _LEET[_a] = _b
_LEET_WORD = B.NOT_ALNUM.copy()
_LEET_WORD[[0x40, 0x24]] = False


def _stem_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each of STEMS the hash of every word's beginning; shorter words have 0."""
    found = []
    for k in STEMS:
        if not k:
            found.append(B.span_hashes(data, starts, ends))
            continue
        h = B.span_hashes(data, starts, np.minimum(ends, starts + k)) ^ np.uint64(k)
        h[ends - starts < k] = 0
        found.append(h)
    return found


def _fixed(words: str) -> np.ndarray:
    texts = pa.array(words.split())
    data, offsets = B.buffer(texts)
    return np.sort(B.span_hashes(data, offsets[:-1], offsets[1:]))


def _member(h: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(h), bool)
    return among[np.minimum(np.searchsorted(among, h), len(among) - 1)] == h


class _Measure:
    """Features of texts under a learned lexicon of hashes and their weights."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, reach: int):
        order = np.argsort(keys)
        self.keys, self.weights, self.reach = keys[order], weights[order], reach
        self.insults, self.second = _fixed(INSULTS), _fixed(SECOND_PERSON)

    def _weight(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.zeros(len(starts))
        whole = None
        for h in _stem_hashes(data, starts, ends):
            whole = h if whole is None else whole
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                w = np.maximum(w, np.where(self.keys[at] == h, self.weights[at], 0))
        return w, whole

    def __call__(self, texts: pa.Array) -> np.ndarray:
        raw, offsets = B.buffer(texts)
        data = B.LOWER[raw]
        starts, ends, first = B.word_spans(data, offsets, B.NOT_ALNUM)
        words = np.diff(first)
        each = np.maximum(words, 1)
        w, whole = self._weight(data, starts, ends)
        fixed = _member(whole, self.insults)
        hit = (w > 0) | fixed
        you = np.concatenate([[0], np.cumsum(_member(whole, self.second))])
        lo, hi = np.repeat(first[:-1], words), np.repeat(first[1:], words)
        at = np.arange(len(starts))
        near = hit & (you[np.minimum(at + self.reach + 1, hi)] > you[np.maximum(at - self.reach, lo)])

        turned = B.LOWER[_LEET[raw]]
        t_starts, t_ends, t_first = B.word_spans(raw, offsets, _LEET_WORD)
        t_w, t_whole = self._weight(turned, t_starts, t_ends)
        odd = np.concatenate([[0], np.cumsum(_LEET[raw] != raw)])
        t_hit = ((t_w > 0) | _member(t_whole, self.insults)) & (odd[t_ends] > odd[t_starts]) if len(t_starts) else np.zeros(0, bool)

        upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
        letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        span = ends - starts
        caps = (upper[ends] - upper[starts] == span) & (span > 1)
        inner = letters[ends] - letters[starts]
        mixed = (inner > 1) & (digits[ends] - digits[starts] > 0) & (inner + digits[ends] - digits[starts] == span) & (span < 12)
        marks = B.NOT_ALNUM[raw] & (raw > 0x20)
        split = np.zeros(len(raw), bool)
        same = np.zeros(len(raw), bool)
        if len(raw) > 2:
            ascii_letter = (data >= 97) & (data <= 122)
            split[1:-1] = ascii_letter[:-2] & np.isin(raw[1:-1], np.frombuffer(b"*.-_@$", np.uint8)) & ascii_letter[2:]
            same[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & ascii_letter[2:]
        size = np.maximum(np.diff(offsets), 1)
        hits, learned, fixed_n = _within(hit, first), _within(w > 0, first), _within(fixed, first)
        strongest = np.zeros(len(words))
        some = words > 0
        if some.any():
            strongest[some] = np.maximum.reduceat(w, first[:-1][some])
        return np.column_stack([
            np.log1p(words), np.log1p(fixed_n), fixed_n / each, np.log1p(learned), learned / each, _within(w, first) / each, strongest,
            np.log1p(hits), np.log1p(_within(t_hit, t_first)), _within(near, first) / np.maximum(hits, 1),
            np.diff(you[first]) / each, _within(caps, first) / each, np.diff(upper[offsets]) / size, _within((raw == 33) | (raw == 63), offsets) / size,
            _within(marks, offsets) / size, _within(mixed, first) / each, _within(split, offsets) / each, _within(same, offsets) / size,
        ])


def _distinct_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct stems by hash, with the label of the text."""
    for whole in batches:
        for batch in B.passes(whole, "text"):
            raw, offsets = B.buffer(batch.column("text"))
            data = B.LOWER[raw]
            starts, ends, first = B.word_spans(data, offsets, B.NOT_ALNUM)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            y = batch.column("y").to_numpy(zero_copy_only=False)
            keys, labels = [], []
            for h in _stem_hashes(data, starts, ends):
                o, k = owner[h != 0], h[h != 0]
                order = np.lexsort((k, o))
                o, k = o[order], k[order]
                fresh = np.ones(len(k), bool)
                fresh[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
                keys.append(k[fresh])
                labels.append(y[o[fresh]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(labels).astype(np.int64))], names=["stem", "y"])


@dataclass(frozen=True)
class ToxicityModel:
    """The fitted measure, its trees (None where one class was missing) and the knots of the calibration curve."""

    measure: _Measure
    trees: GBTClassificationModel | None
    curve: tuple[tuple[float, float], ...]


class ToxicityClassifier:
    """Scores documents for toxicity; ``predicted`` is 1 from 0.5 on.

    Lexicon, trees and calibration are fitted on at most ``bound`` labelled
    rows outside the held-out fold; a quarter of them, dealt by a hash of the
    id, is kept from lexicon and trees and calibrates their margin. At most ``lexicon`` stems
    enter the learned lexicon. ``score`` returns ``doc_id, held_out, score,
    predicted, margin``, ``keep`` the documents that score below 0.5.

    Defined cases: a null text counts as empty and is scored like any other. A
    null id is scored and not held out. Repeated rows are each scored. If the
    sample lacks one of the classes, every document scores the share of toxic
    rows in it (0 without rows). An empty table gives no rows. Other columns
    are not read.
    """

    def __init__(self, bound: int = 20_000, parts: int = 5, held_out: int = 0, lexicon: int = 2_000, least_docs: int = 4, least_odds: float = 2.0, reach: int = 5, trees: int = 20, depth: int = 4):
        self.bound, self.parts, self.held_out, self.lexicon = bound, parts, held_out, lexicon
        self.least_docs, self.least_odds, self.reach, self.trees, self.depth = least_docs, least_odds, reach, trees, depth

    def learn_lexicon(self, texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and log-odds of the stems that mark toxic ones among ``texts(text, y)``."""
        totals = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
        counts = texts.select("text", "y").mapInArrow(_distinct_stems, "stem long, y long").groupBy("stem").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
        odds = F.log((F.col("bad") + 0.5) / (totals.get(1, 0) + 1.0)) - F.log((F.col("good") + 0.5) / (totals.get(0, 0) + 1.0))
        best = (
            counts.where(F.col("bad") >= self.least_docs)
            .withColumn("odds", odds)
            .where(F.col("odds") >= self.least_odds)
            .orderBy(F.desc(F.col("odds") * F.log1p("bad")), "stem")
            .limit(self.lexicon)
            .select("stem", "odds")
            .collect()
        )
        return np.array([r.stem for r in best], np.int64).view(np.uint64), np.array([r.odds for r in best], float)

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
        scratch = Scratch(docs.sparkSession, "toxicity")
        sample = labelled_sample(labels, "toxic", self.bound, self.parts, self.held_out)
        source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        calibrates = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(4)) == 0
        known = scratch.save(source.join(F.broadcast(sample), "id").select("text", "y", calibrates.alias("calibrates")))  # the sample is bounded
        keys, odds = self.learn_lexicon(known.where("not calibrates"))
        measure = _Measure(keys, odds, self.reach)
        seen = {(r.y, r.calibrates): r.n for r in known.groupBy("y", "calibrates").agg(F.count("*").alias("n")).collect()}
        if not seen.get((0, False)) or not seen.get((1, False)):
            share = sum(n for (y, _), n in seen.items() if y) / max(1, sum(seen.values()))
            scratch.keep()
            return ToxicityModel(measure, None, ((0.0, share),))
        measured = known.select(feature_column(measure, F.col("text")).alias("x"), F.col("y").cast("double").alias("label"), "calibrates")
        measured = scratch.save(measured.coalesce(4)).select(array_to_vector("x").alias("features"), "label", "calibrates")
        trees = GBTClassifier(maxIter=self.trees, maxDepth=self.depth, stepSize=0.3, subsamplingRate=0.8, seed=5, featureSubsetStrategy="all").fit(measured.where("not calibrates"))
        both = seen.get((0, True)) and seen.get((1, True))
        margins = trees.transform(measured.where("calibrates") if both else measured).select(vector_to_array("rawPrediction")[1].alias("margin"), "label")
        curve = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(margins)
        scratch.keep()
        return ToxicityModel(measure, trees, tuple(zip(curve.boundaries.toArray().tolist(), curve.predictions.toArray().tolist())))

    def _scored(self, rows: DataFrame, model: ToxicityModel, text: Column) -> DataFrame:
        """The rows, with ``margin`` and ``score``."""
        if model.trees is None:
            return rows.withColumn("margin", F.lit(0.0)).withColumn("score", F.lit(float(model.curve[0][1])))
        measured = rows.withColumn("features", array_to_vector(feature_column(model.measure, text)))
        scored = model.trees.transform(measured).withColumn("margin", vector_to_array("rawPrediction")[1])
        return scored.withColumn("score", _along(model.curve))

    def score(self, docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        held_out = F.coalesce(fold("doc_id", self.parts) == self.held_out, F.lit(False)).alias("held_out")
        return self._scored(rows, model, F.col("text")).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "margin")

    def keep(self, docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
        """The documents that aren't judged toxic, with all their columns."""
        return self._scored(docs.select(F.struct("*").alias("d")), model, F.col(f"d.`{text_col}`")).where("score < 0.5").select("d.*")


def _along(knots: tuple[tuple[float, float], ...]) -> Column:
    """The calibration curve over ``margin``: linear between its knots, with a slight slope so that it keeps the margin's order."""
    kept = [k for i, k in enumerate(knots) if i in (0, len(knots) - 1) or not knots[i - 1][1] == k[1] == knots[i + 1][1]]
    x = F.col("margin")
    curve = F.when(x <= kept[0][0], F.lit(kept[0][1]))
    for (a, u), (b, v) in zip(kept, kept[1:]):
        curve = curve.when(x <= b, F.lit(u) + (x - a) * ((v - u) / (b - a) if b > a else 0.0))
    curve = curve.otherwise(F.lit(kept[-1][1]))
    return curve * 0.998 + 0.002 / (1 + F.exp(-x))
