"""Secrets in texts: a scan for candidates and a random forest against false positives.

Candidates are the runs of at least ``least`` key characters, split at the ``=``
behind a name and once more at path parts; shorter runs of a known format; and
whatever a secret word announces by ``=`` or ``:``, from ``short`` characters.
Runs of letters in the case of words (small, capitalised, capitals, or such
parts side by side) are candidates only if something announces them: whatever
their length, they are words. A forest, trained from the findings of the same
scan over labelled examples, judges each candidate by its length, its
transitions between character classes, how much of it dictionary words cover,
the path it was found under and the words around it. The dictionary is the
corpus's own: its letter words that most documents hold. Findings carry their
spans, so texts can be redacted.
"""

from __future__ import annotations

import math
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytetext as B
from .storage import Scratch

# Formats that providers publish, words that announce secrets, words that announce other long strings,
# path parts of example material, and dictionary words that occur in identifiers and placeholders.
FORMATS = {
    "aws_access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "google_api_key": r"AIza[0-9A-Za-z_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
SECRET_WORDS = "token secret password passwd pwd apikey api_key api-key access_key accesskey private_key auth authorization bearer credential credentials key"
OTHER_WORDS = "commit sha sha1 sha256 md5 checksum digest hash uuid guid id revision etag version build image href src url http https path file"
EXAMPLE_PATHS = "test tests testing example examples sample samples fixture fixtures mock demo docs tutorial"
DICTIONARY = (
    "access account action address admin alpha application array author backup banner base beta block body branch browser buffer build button cache card change channel class client code collection "
    "color column command comment common component config connection content context control copy count create current custom data database date debug default delete demo description design detail device "
    "dialog display document download driver dummy edit element email empty entry error event example export factory feature field file filter font footer form format frame function gallery general group "
    "handler header hello help here hidden home icon identifier image index info input insert install instance interface item label language layout library license limit line link list load local login "
    "main manager mapping master member menu message method model module name native network node normal number object offset option order output package page panel parent parser password path pattern "
    "picture placeholder player plugin point position post preview price process product profile project property public query random record release report request resource response result return role "
    "root route sample schema scope score screen script search section secret select server service session setting shadow simple size source stack start state static status step storage string style "
    "submit summary system table target task template test text theme thread time title token tool total track type update upload user utility value vector version video view warning widget window word your"
)

FEATURES = (
    "length", "transitions", "entropy", "digits", "uppers", "lowers", "marks", "hex", "longest_letters", "distinct", "dictionary",
    "example_path", "secret_word_near", "secret_word_next", "other_word_near", "assigned", "quoted", "known_format", "uuid_shape", "url_like",
    "equals", "consonants",
)

_FORMAT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMATS.items()))
_UUID = re.compile(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_WORD = re.compile(r"[A-Za-z_-]+[0-9]*")
_SECRET, _OTHER, _EXAMPLE, _DICTIONARY = (frozenset(x.split()) for x in (SECRET_WORDS, OTHER_WORDS, EXAMPLE_PATHS, DICTIONARY))
#: The longest words that count as dictionary words.
_LONGEST = 24
#: Bytes of ASCII letters in small, all others as blanks.
_LETTERS = bytes(b | 0x20 if chr(b & 0x7F).isalpha() and b < 0x80 else 0x20 for b in range(256))
#: Distinct words that a counting task holds before it passes their counts on.
_HELD_WORDS = 1 << 18
#: Letters in the case of words, with marks between the parts.
_WORDS_ONLY = re.compile(r"[A-Z]*[a-z]*(?:[-_./+~=]*(?:[A-Z][a-z]{2,}|[A-Z]{2,}|(?<![A-Za-z])[A-Za-z]?[a-z]*))*")
#: The characters of the shortest known format.
_SHORTEST_FORMAT = 15
_KEYS = "A-Za-z0-9_+/=.~-"
#: A value behind ``=`` or ``:``, in quotes or up to a blank or a separator, and the name that ends before the sign.
_VALUE = re.compile(r"""[:=]>?[ \t]{0,4}(?:(?i:bearer|basic)[ \t]+)?(?:"([^"\n]{1,200})"|'([^'\n]{1,200})'|`([^`\n]{1,200})`|([^\s"'`<>,;&(){}\[\]|=:][^\s"'`<>,;&(){}\[\]|]*))""")
_NAME = re.compile(r"""([A-Za-z][A-Za-z0-9_.-]*)["'`]?[ \t]{0,4}:?$""")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_ANNOUNCING = re.compile("token|secret|passw|pwd|api_?-?key|access_?-?key|private_?-?key|credential|authorization", re.I)


def _announces(name: str) -> bool:
    return bool(_ANNOUNCING.search(name)) or any(p.lower() in _SECRET for p in _PARTS.findall(name))


def spans(text: str, least: int, short: int) -> list[tuple[int, int]]:
    """The candidates' spans in order; one may lie inside another, as a part of a path does."""
    found = set()

    def take(a: int, b: int) -> None:
        while b > a and text[b - 1] in ".-_":
            b -= 1
        known = b - a >= _SHORTEST_FORMAT and _FORMAT.search(text, a, b)
        if (known or b - a >= least and not _WORDS_ONLY.fullmatch(text, a, b)) and any(c.isalnum() for c in text[a:b]):
            found.add((a, b))

    for m in _runs(min(least, _SHORTEST_FORMAT)).finditer(text):
        a, b = m.span()
        at = text.find("=", a, b)
        ends = [(a, b)]
        if at >= 0 and (rest := text[at:b].lstrip("=")):
            ends = [(a, at), (b - len(rest), b)]
        for x, y in ends:
            take(x, y)
            if "/" in text[x:y]:
                for part in re.compile("[^/]+").finditer(text, x, y):
                    take(*part.span())
    for m in _VALUE.finditer(text):
        name = _NAME.search(text, max(0, m.start() - 64), m.start())
        if name and _announces(name[1]):
            a, b = m.span(m.lastindex)
            while b > a and m.lastindex == 4 and text[b - 1] in ".-_?":
                b -= 1
            if b - a >= short and any(c.isalnum() for c in text[a:b]):
                found.add((a, b))
    return sorted(found)


@cache
def _runs(least: int) -> re.Pattern:
    return re.compile(f"(?<![{_KEYS}])[{_KEYS}]{{{least},}}")


def _covered(candidate: str, words: frozenset[str]) -> float:
    """The share of the candidate's characters that dictionary words of four letters or more cover, longest first from the left."""
    text, at, covered = candidate.lower(), 0, 0
    while at < len(text):
        for k in range(min(_LONGEST, len(text) - at), 3, -1):
            if text[at : at + k] in words:
                covered += k
                at += k
                break
        else:
            at += 1
    return covered / len(text)


def measure(candidate: str, before: str, after: str, path: str, words: frozenset[str] = _DICTIONARY) -> list[float]:
    """FEATURES of one candidate; ``before`` and ``after`` are the text around it."""
    n = len(candidate)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in candidate]
    counts = np.unique(list(candidate), return_counts=True)[1] / n
    near = [w.lower().strip("-_") for w in _WORD.findall(before)][-5:]
    parts = [p for w in near[-3:] for p in (w, *re.split("[_-]", w))]
    tight = before.rstrip(" \"'`")
    return [
        math.log(n),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        float(-(counts * np.log2(counts)).sum()),
        kinds.count("d") / n,
        kinds.count("u") / n,
        kinds.count("l") / n,
        kinds.count("m") / n,
        float(all(c in "0123456789abcdefABCDEF" for c in candidate)),
        max((len(x) for x in re.findall("[A-Za-z]+", candidate)), default=0) / n,
        len(counts) / n,
        _covered(candidate, words),
        float(any(p in _EXAMPLE for p in re.split(r"[^a-z]+", path.lower()))),
        float(any(w in _SECRET for w in near)),
        float(any(p in _SECRET for p in parts)),
        float(any(w in _OTHER for w in near[-2:])),
        float(tight.endswith(("=", ":", ">"))),
        float(before[-1:] in ("'", '"', "`") and after[:1] in ("'", '"', "`")),
        float(bool(_FORMAT.search(candidate))),
        float(bool(_UUID.match(candidate))),
        float("://" in before[-12:] or "/" in candidate[:1] or "www." in candidate or ".com" in candidate or "@" in after[:1] + before[-1:]),
        float(before.rstrip("\"'`")[-1:] == "="),
        max((len(x) for x in re.findall("[b-df-hj-np-tv-xz]+", candidate.lower())), default=0) / n,
    ]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter words and the number of texts that hold them; a word may come several times."""
    counts: Counter = Counter()

    def passed_on() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    for whole in batches:
        for batch in B.passes(whole, "text"):
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                counts.update({w for w in (text or b"").translate(_LETTERS).split() if 4 <= len(w) <= _LONGEST})
            if len(counts) > _HELD_WORDS:
                yield passed_on()
    yield passed_on()


def _scanner(least: int, short: int, around: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = sent.value
        for whole in batches:
            for batch in B.passes(whole, "text"):
                rows: list[tuple] = []
                ids, prints = batch.column("doc_id").to_pylist(), batch.column("print").to_pylist()
                paths, texts = batch.column("path").to_pylist(), batch.column("text").to_pylist()
                for doc_id, mark, path, text in zip(ids, prints, paths, texts):
                    text = text or ""
                    for a, b in spans(text, least, short):
                        word, before, after = text[a:b], text[max(0, a - around) : a], text[b : b + 16]
                        known = _FORMAT.search(word)
                        rows.append((doc_id, mark, a, b, known.lastgroup if known else "generic", word, measure(word, before, after, path or "", dictionary)))
                columns = list(zip(*rows)) or [[]] * 7
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "print", "start", "end", "kind", "candidate", "x"])

    return run


def example_findings(n: int = 4000, seed: int = 11, words: tuple[str, ...] = ()) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings ``(candidate, before, after, path, is_secret)`` of the usual true and false kinds.

    Words of the language are drawn from ``words`` too, alone and side by side,
    in small letters, capitalised and in capitals.
    """
    r = random.Random(seed)
    language = list(words) or DICTIONARY.split()
    in_case = lambda w: r.choice([w, w, w.capitalize(), w.capitalize(), w.upper()])
    of = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper, hexa = lower.upper(), "0123456789abcdef"
    words = DICTIONARY.split()
    syllables = [a + b for a in "bcdfghlmnprstv" for b in ("a", "e", "i", "o", "u", "en", "er", "ion")]
    prose = lambda k=4: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(k))
    found = []
    for i in range(n):
        path = r.choice(["src/app", "config/prod", "deploy", "src3", "web/main", "notes"])
        lead, tail = prose() + " ", " " + prose(2)
        if i % 2:
            body = r.choice([
                lambda: of(hexa, r.choice([32, 40, 40, 64])), lambda: of(lower + upper + digits, r.randint(20, 64)), lambda: of(lower + upper + digits + "+/", 40),
                lambda: "AKIA" + of(upper + digits, 16), lambda: "ghp_" + of(lower + upper + digits, 36), lambda: "sk_live_" + of(lower + upper + digits, 24),
                lambda: "xoxb-" + of(digits, 12) + "-" + of(lower + upper + digits, 24), lambda: f"eyJ{of(lower + upper + digits, 20)}.eyJ{of(lower + upper + digits, 30)}.{of(lower + upper + digits, 43)}",
            ])()
            name = r.choice(["token", "token", "secret", "password", "api_key", "api-key", "ACCESS_KEY", "client_secret", "auth_token", "Authorization: Bearer", "key"])
            join = r.choice([' = "', "=", ": ", ' = "', "='", ' := "']) if "Bearer" not in name else " "
            if i % 3 == 1:  # passwords: short, of letters only, with marks
                body = r.choice([
                    lambda: of(lower, r.randint(8, 24)), lambda: of(lower + upper, r.randint(8, 24)), lambda: of(lower + digits, r.randint(6, 15)), lambda: of(lower + upper + digits + "!@#$%*", r.randint(6, 16)),
                    lambda: "".join(r.sample(syllables, 3)) + of(digits, r.randint(2, 4)), lambda: "xoxb-" + of(lower + digits, r.randint(10, 12)),
                ])()
                name, join = r.choice(["password", "passwd", "pwd", "db_password", "DB_PASSWORD", "secret", "token", "api_key"]), r.choice([' = "', "=", "=", "=", ": ", "='"])
            shout = r.random() < 0.25
            before = lead + (name.upper() if shout else name) + join
            body = body.upper() if shout and re.fullmatch("[0-9a-f]+", body) else body
            found.append((body, before, ('"' if '"' in join else "'" if "'" in join else "") + tail, path, 1))
            continue
        kind = r.randrange(13)
        after = tail
        if kind == 0:
            body, before = of(hexa, 40), lead + r.choice(["commit ", "revision ", "commit: "])
        elif kind == 1:
            body, before = of(hexa, r.choice([32, 64])), lead + r.choice(["sha256:", "md5 checksum ", "digest: ", "etag: \""])
        elif kind == 2:
            body, before = str(uuid.UUID(int=r.getrandbits(128))), lead + r.choice(["id=", "uuid: ", 'id = "', ""])
        elif kind == 3:
            body, before = "/".join(["", *r.sample(words, r.randint(3, 5))]) + r.choice(["", ".py", "2.txt"]), lead
        elif kind == 4:
            body, before = "".join(w.capitalize() for w in r.sample(words, 4)) + of(digits, r.randint(1, 2)), lead
        elif kind == 5:
            body, before = "_".join(r.sample(words, 3)) + "_" + of(digits, 3), lead + r.choice(["", "token = ", "key="])
        elif kind == 6:
            body, before = r.choice(["YOUR_API_KEY_HERE", "your-secret-token-here", "XXXXXXXXXXXXXXXXXXXX", "example-token-" + of(digits, 8), "test_password_" + of(digits, 4), "0000000000000000"]), lead + r.choice(['token = "', "api_key=", "password: "])
            after = '"' + tail
        elif kind == 7:
            body, before = f"{r.choice(words)}.example.com/{r.choice(words)}/{of(digits, 4)}.html", lead + r.choice(["https://", "http://", ""])
        elif kind == 8:
            body, before, path = of(hexa, 40), lead + 'token = "', r.choice(["tests/fixtures", "docs/examples", "sample/demo"])
            after = '"' + tail
        elif kind == 10:  # announced, but a word of the language or a name
            body, before = r.choice([lambda: r.choice(words), lambda: r.choice(["true", "false", "null", "none", "required", "optional", "string", "changeme"]), lambda: "_".join(r.sample(words, 2)), lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4))), *3 * [lambda: in_case("".join(r.choice(language) for _ in range(r.choice([1, 1, 2, 3]))))]])(), lead + r.choice(["token: ", "password: ", "key: ", "key = ", "secret: ", "auth: "])
        elif kind == 11:  # a long word
            body, before = in_case("".join(r.choice(syllables) for _ in range(r.randint(7, 10)))), lead
        elif kind == 12:  # other assignments
            body, before = r.choice([lambda: of(hexa, 40), lambda: "".join(r.choice(words) for _ in range(4)), lambda: "".join(r.sample(words, 2)) + of(digits, 12)])(), lead + r.choice(["commit=", "etag=", "name=", "file=", "id="])
        else:
            body, before = ".".join(of(digits, r.randint(1, 3)) for _ in range(6)) + r.choice(["-alpha." + of(digits, 8), ".dev" + of(digits, 6), "-" + of(digits, 6)]), lead + r.choice(["version ", "", "build "])
        found.append((body, before, after, path, 0))
    return found


@dataclass(frozen=True)
class SecretModel:
    """The forest and the dictionary that it was trained with."""

    forest: RandomForestClassificationModel
    words: frozenset[str]

    def transform(self, rows: DataFrame) -> DataFrame:
        """Judges rows that have ``features``, as the forest does."""
        return self.forest.transform(rows)


class SecretScanner:
    """Finds, judges and redacts secrets.

    ``lexicon`` counts the corpus's letter words over all texts and returns the
    ``dictionary`` ones that most documents hold. ``fit`` trains the forest from
    labelled findings (by default the usual true and false kinds) with such
    words; without a model ``scan`` and ``redact`` do both. ``scan`` returns ``doc_id, start, end, kind, candidate,
    score, is_secret`` for every candidate, spans in characters. ``redact``
    returns the documents with the secrets replaced and ``n_chars`` brought up
    to date where there is such a column.

    Defined cases: null and empty texts have no findings and stay as they are.
    Null ids are scanned and redacted too. Repeated rows are each scanned; for
    redaction spans belong to an id and a text, so rows that share an id never
    mix. A null path is an empty one. An empty table gives no rows. ``redact``
    keeps all other columns, whatever their names.
    """

    def __init__(self, least: int = 16, around: int = 80, trees: int = 40, depth: int = 8, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", short: int = 4, dictionary: int = 20_000):
        self.dictionary = dictionary
        self.least, self.short, self.around, self.trees, self.depth, self.threshold = least, short, around, trees, depth, threshold
        self.id_col, self.text_col, self.path_col = id_col, text_col, path_col

    def lexicon(self, docs: DataFrame) -> list[str]:
        """The letter words of 4 to 24 letters that most documents hold, at least five each; ``dictionary`` words at most reach the driver."""
        counted = docs.select(F.col(self.text_col).cast("string").alias("text")).mapInArrow(_word_counts, "word string, n long")
        most = counted.groupBy("word").agg(F.sum("n").alias("n")).where("n >= 5").orderBy(F.desc("n"), "word").limit(self.dictionary)
        return sorted(r.word for r in most.collect())

    def fit(self, spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None, words: list[str] | tuple[str, ...] = ()) -> SecretModel:
        dictionary = _DICTIONARY | frozenset(words)
        told = findings if findings is not None else example_findings(words=tuple(words))
        seen = [row for finding in told for row in self._seen(dictionary, *finding)]
        rows = pa.table({"x": pa.array([x for x, _ in seen]), "label": pa.array([y for _, y in seen])})
        known = spark.createDataFrame(rows).select(array_to_vector("x").alias("features"), "label")
        return SecretModel(RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, seed=3).fit(known), dictionary)

    def _seen(self, words: frozenset[str], candidate: str, before: str, after: str, path: str, is_secret: int) -> list[tuple[list[float], float]]:
        """Features and labels of what the scan finds in an example's whole text; only spans that meet the candidate share its label."""
        text, start, end = before + candidate + after, len(before), len(before) + len(candidate)
        found = spans(text, self.least, self.short)
        rows = [(measure(text[a:b], text[max(0, a - self.around) : a], text[b : b + 16], path, words), float(bool(is_secret) and a < end and b > start)) for a, b in found]
        # A secret that no scan meets keeps its label; words that are no candidates teach nothing.
        return rows if not is_secret or any(a < end and b > start for a, b in found) else [*rows, (measure(candidate, before, after, path, words), 1.0)]

    def _candidates(self, docs: DataFrame, words: frozenset[str]) -> DataFrame:
        path = F.col(self.path_col).cast("string") if self.path_col and self.path_col in docs.columns else F.lit("")
        source = docs.select(F.col(self.id_col).cast("long").alias("doc_id"), F.xxhash64(self.text_col).alias("print"), path.alias("path"), F.col(self.text_col).cast("string").alias("text"))
        schema = "doc_id long, print long, start long, end long, kind string, candidate string, x array<double>"
        sent = docs.sparkSession.sparkContext.broadcast(words)
        return source.mapInArrow(_scanner(self.least, self.short, self.around, sent), schema)

    def _judged(self, docs: DataFrame, model: SecretModel) -> DataFrame:
        judged = model.transform(self._candidates(docs, model.words).withColumn("features", array_to_vector("x")))
        return judged.withColumn("score", vector_to_array("probability")[1]).withColumn("is_secret", F.col("score") >= self.threshold)

    def scan(self, docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
        model = model or self.fit(docs.sparkSession, words=self.lexicon(docs))
        return self._judged(docs, model).select("doc_id", "start", "end", "kind", "candidate", "score", "is_secret")

    def redact(self, docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
        spark = docs.sparkSession
        model = model or self.fit(spark, words=self.lexicon(docs))
        scratch = Scratch(spark, "secrets")
        found = scratch.save(self._judged(docs, model).where("is_secret").select(F.col("doc_id").alias("f_id"), F.col("print").alias("f_print"), "start", "end", "kind")).distinct()
        # Spans that overlap are replaced as one: a new one begins where no earlier span reaches.
        own = Window.partitionBy("f_id", "f_print").orderBy("start", "end", "kind")
        apart = F.coalesce(F.col("start") >= F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
        found = found.withColumn("apart", apart.cast("int")).withColumn("nth", F.sum("apart").over(own))
        whole = found.groupBy("f_id", "f_print", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
        hidden = whole.groupBy("f_id", "f_print").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("f_spans"))
        hidden = scratch.save(hidden)
        scratch.keep(hidden)
        text, doc_id = F.col(f"d.`{self.text_col}`"), F.col(f"d.`{self.id_col}`").cast("long")
        # Kept text between the spans, each span replaced by its kind.
        ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("f_spans", lambda s: s["end"]))
        kept = F.transform(F.sequence(F.lit(0), F.size("f_spans") - 1), lambda i: F.concat(
            F.substring(text, F.get(ends, i).cast("int") + 1, (F.get("f_spans", i)["start"] - F.get(ends, i)).cast("int")), F.lit("[REDACTED:"), F.get("f_spans", i)["kind"], F.lit("]")))
        tail = F.substring(text, F.element_at(ends, -1).cast("int") + 1, F.length(text))
        clean = F.when(F.col("f_spans").isNull(), text).otherwise(F.concat(F.array_join(kept, ""), tail))
        joined = docs.alias("d").join(hidden.alias("f"), doc_id.eqNullSafe(F.col("f.f_id")) & (F.xxhash64(text) == F.col("f.f_print")), "left")
        own = [F.col(f"d.`{c}`") for c in docs.columns]
        out = joined.select(*[clean.alias(c) if c == self.text_col else o for c, o in zip(docs.columns, own)])
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.length(self.text_col).cast(docs.schema["n_chars"].dataType))
        return out
