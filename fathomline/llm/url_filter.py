"""URL verdicts by rules, and by two character language models where no rule fits.

Native throughout: every step is a DataFrame expression.

* Rules name a host and the beginning of a path; the longest that fits decides.
* The URLs that rules decide train two Markov models, of accepted and of
  rejected URLs, over a closed alphabet. Each mixes the orders two, one and
  zero by Witten-Bell smoothing: how far a context is trusted depends on how
  often it was seen and with how many continuations.
* A URL's score is the difference of its log-likelihoods, divided by its
  length. The cut between the two verdicts is calibrated on the same URLs.

With a closed alphabet of V symbols a model is V^3 numbers whatever the corpus,
so the table of log-ratios has a fixed size and is broadcast. A URL's symbols
are summed before they are shuffled: one short row for each URL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Scratch

#: Symbols of the models: letters, digits, marks of URLs, ~ for all else and $ for the end. Number 0 stands before the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&%#:~$"
V = len(ALPHABET) + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scores are calibrated in steps of this size, between -RANGE and RANGE steps.
STEP, RANGE = 0.001, 8000

Rule = tuple[str, str, str]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty for a null or for no ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


class UrlFilter:
    """``judge(pages)`` returns ``page_id, host, path, rule, verdict, score`` for every row.

    ``rules`` are ``(verdict, host, path)``; a rule holds for its host and all
    subdomains if the path starts with the rule's, the longest (host and path
    together, then the alphabetically first) wins.

    Defined cases: a null url, or one without ``://``, has an empty host and
    path, fits no rule, and is scored as an empty text. Null and repeated page
    ids are judged row by row. Without URLs of both verdicts among those that
    rules decide there is no model: all others are allowed with a null score.
    An empty table gives no rows. Other columns are not read.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.rules = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def _decided(self, pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
        rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
        host, path = url_parts(F.col("url"))
        rows = rows.withColumns({"host": host, "path": path})
        rule = F.lit(None).cast("string")
        verdict = F.lit(None).cast("string")
        for said, on, begin in reversed(self.rules):
            fits = ((F.col("host") == on) | F.col("host").endswith("." + on)) & F.col("path").startswith(begin)
            rule, verdict = F.when(fits, F.lit(on + begin)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
        start = F.instr("url", "://")
        text = F.when(start > 0, F.substring(F.col("url"), start + 3, F.length("url"))).otherwise(F.lit(""))
        text = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
        text = F.concat(F.regexp_replace(text, r"[^a-z0-9./\-_?=&%#:]", "~"), F.lit("$"))
        return rows.withColumns({"rule": rule, "said": verdict, "symbols": text})

    @staticmethod
    def _grams() -> Column:
        """Each position's symbol and the two before it, as one number."""
        return F.expr(
            f"transform(sequence(1, length(symbols)), i -> cast("
            f"if(i < 3, 0, instr('{ALPHABET}', substring(symbols, i - 2, 1))) * {V * V}"
            f" + if(i < 2, 0, instr('{ALPHABET}', substring(symbols, i - 1, 1))) * {V}"
            f" + instr('{ALPHABET}', substring(symbols, i, 1)) as int))"
        )

    def _model(self, decided: DataFrame) -> DataFrame:
        """``gram, ratio``: the log-ratio of both models for every gram; null without both kinds of URLs."""
        told = decided.where("said is not null").select((F.col("said") == "allow").cast("int").alias("good"), F.explode(self._grams()).alias("gram"))
        counts = told.groupBy("gram").agg(*[F.sum((F.col("good") == y).cast("long")).alias(f"n{y}") for y in (0, 1)])
        grid = decided.sparkSession.range(V**3).select(F.col("id").cast("int").alias("gram")).join(counts, "gram", "left")
        c, b = F.col("gram") % V, F.floor(F.col("gram") / V) % V
        grid = grid.withColumns({"c": c, "b": b, "ab": F.floor(F.col("gram") / V)})
        for y in (0, 1):
            n = F.coalesce(F.col(f"n{y}"), F.lit(0))
            by = lambda *k: Window.partitionBy(*k)
            pair, single = F.sum(n).over(by("b", "c")), F.sum(n).over(by("c"))
            seen_b, seen_ab = F.sum(n).over(by("b")), F.sum(n).over(by("ab"))
            grid = grid.withColumns({"n": n, "pair": pair, "single": single, "seen_b": seen_b, "seen_ab": seen_ab, "all": F.sum(n).over(by(F.lit(0)))})
            # Of a pair's rows, one for each symbol before it, the one with the symbol 0 counts for the kinds of continuations.
            kinds_b = F.sum(F.when((F.floor(F.col("ab") / V) == 0) & (F.col("pair") > 0), 1).otherwise(0)).over(by("b"))
            kinds_ab = F.sum((F.col("n") > 0).cast("int")).over(by("ab"))
            p0 = (F.col("single") + 1) / (F.col("all") + V)
            grid = grid.withColumns({"kinds_b": kinds_b, "kinds_ab": kinds_ab, "p": p0})
            grid = grid.withColumn("p", F.when(F.col("seen_b") > 0, (F.col("pair") + F.col("kinds_b") * F.col("p")) / (F.col("seen_b") + F.col("kinds_b"))).otherwise(F.col("p")))
            grid = grid.withColumn("p", F.when(F.col("seen_ab") > 0, (F.col("n") + F.col("kinds_ab") * F.col("p")) / (F.col("seen_ab") + F.col("kinds_ab"))).otherwise(F.col("p")))
            grid = grid.withColumn(f"p{y}", F.when(F.col("all") > 0, F.log("p")))
        return grid.select("gram", (F.col("p1") - F.col("p0")).alias("ratio"))

    def _scored(self, decided: DataFrame, model: DataFrame) -> DataFrame:
        own = ["row", "page_id", "host", "path", "rule", "said"]
        symbols = decided.withColumn("row", F.monotonically_increasing_id()).select(*own, F.explode(self._grams()).alias("gram"))
        return symbols.join(F.broadcast(model), "gram").groupBy(*own).agg(F.avg("ratio").alias("score"))  # the model has V^3 rows

    @staticmethod
    def _cut(scored: DataFrame) -> DataFrame:
        """One row: the cut with the best sum of both verdicts' accuracies on the URLs that rules decide, the lowest if several tie."""
        step = F.greatest(F.least(F.floor(F.col("score") / STEP), F.lit(RANGE)), F.lit(-RANGE)).alias("step")
        told = scored.where("said is not null and score is not null").groupBy(step).agg(*[F.sum((F.col("said") == y).cast("long")).alias(y) for y in ("allow", "block")])
        ahead = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * RANGE + 1 rows
        whole = Window.partitionBy(F.lit(0))
        lost = F.coalesce(F.sum("allow").over(ahead), F.lit(0)) / F.sum("allow").over(whole)
        caught = F.coalesce(F.sum("block").over(ahead), F.lit(0)) / F.sum("block").over(whole)
        return told.select("step", (caught - lost).alias("gain")).agg(F.max_by(F.col("step") * STEP, F.struct("gain", -F.col("step"))).alias("cut"))

    def judge(self, pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
        scratch = Scratch(pages.sparkSession, "url-filter")
        decided = self._decided(pages, id_col, url_col)
        model = scratch.save(self._model(decided))
        scored = self._scored(decided, model)
        cut = scratch.save(self._cut(scored)).select("cut").scalar()
        method = F.when(F.col("score") < cut, F.lit("block")).otherwise(F.lit("allow"))
        return scored.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "score")
