"""Text expressions. All are built-in SQL functions, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token, white-space, line and chapter patterns.
LATIN_TOKEN = "[a-z0-9]+"
CJK_RUN = "[\\x{4E00}-\\x{9FFF}]+"
SPACE = "(?U)[\\s\\x1c-\\x1f]"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
CHAPTER = (
    "(?i)^(第\\s*[0-9]{1,3}\\s*[章回]|第\\s*[一二三四五六七八九十百零]{1,7}\\s*[章回]|第\\s*[0-9一二三四五六七八九十]{1,7}\\s*[部篇卷]"
    "|\\bChapter\\s+\\d{1,3}\\b|\\bPart\\s+(?:One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|[IVXLC]{1,6}|\\d{1,2})\\b)"
)


def tokens(text: Column) -> Column:
    """Latin and digit words of two characters or more, then CJK bigrams (single characters where a run has one)."""
    low = F.lower(text)
    latin = F.filter(F.regexp_extract_all(low, F.lit(LATIN_TOKEN), F.lit(0)), lambda t: F.length(t) >= 2)
    pairs = F.transform(
        F.regexp_extract_all(low, F.lit(CJK_RUN), F.lit(0)),
        lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: run.substr(i, F.lit(2)))
        ),
    )
    return F.concat(latin, F.flatten(pairs))


def strip(text: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def strip_column(text: Column) -> Column:
    """The same for a plain column of long texts: one that has none there isn't searched."""
    ends = F.substring(text, 1, 1).rlike(SPACE) | F.substring(text, -1, 1).rlike(SPACE)
    return F.when(ends, strip(text)).otherwise(text)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def clip(text: Column, limit: int, suffix: str = "…") -> Column:
    """White space collapsed, cut to ``limit`` characters; what was cut is marked by the suffix."""
    flat = collapse(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit(suffix))).otherwise(flat)


def lines(text: Column) -> Column:
    """Lines at any Unicode line break; a break at the end opens no further line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def json_or(text: Column, schema: str, default: Column) -> Column:
    """The struct that a JSON text holds, or the default where there is none that parses."""
    said = F.from_json(text, f"{schema}, _malformed string", {"columnNameOfCorruptRecord": "_malformed"})
    return F.when(text.isNull() | (F.trim(text) == "") | said["_malformed"].isNotNull(), default).otherwise(said.dropFields("_malformed"))


def chapter_hint(text: Column) -> Column:
    """The first short line that looks like a chapter title, up to 48 characters; null without one."""
    short = F.filter(F.transform(lines(text), strip), lambda s: (F.length(s) > 0) & (F.length(s) <= 60) & s.rlike(CHAPTER))
    return F.substring(F.get(short, F.lit(0)), 1, 48)


def contains_folded(text: Column, part: Column) -> Column:
    """Case-insensitive substring test; everything contains the empty string."""
    return F.coalesce(F.contains(F.lower(text), F.lower(part)), F.lit(False))
