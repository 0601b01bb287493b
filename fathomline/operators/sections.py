"""From file texts to sections, pieces and chunks. Input rows are ``rel, text`` and what else they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions import paths
from fathomline.functions.text import SPACE, chapter_hint, lines, strip, strip_column
from fathomline.sources.tables import PLACE, Tables, in_blocks

# The heading, page-marker, timing and cue-number patterns, the title before the first heading, and the least length of a piece.
HEADING = r"^#{1,6}(?U)\s+(.*)"
PAGE_LINE = r"(?m)^[ \t]*\[p\.(\p{Nd}+)\][ \t]*$"
TIMING = r"^\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}[.,]\p{Nd}{3}(?U)\s*-->"
CUE_NUMBER = r"^\p{Nd}+(?U)\s*$"
PREAMBLE = "（引言）"
LEAST_PIECE = 40


def char_window(files: DataFrame, size: int = 1200, overlap: int = 120, text: str = "text") -> DataFrame:
    """Windows of a text: columns ``piece`` (from 0) and ``body`` in place of the text. A text that fits is one window."""
    step = max(1, size - overlap)
    starts = F.when(F.length(text) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)))
    cut = files.select("*", F.posexplode(starts).alias("piece", "at"))
    body = F.col(text).substr(F.col("at") + 1, F.lit(size))
    return cut.select(*[c for c in files.columns if c != text], "piece", body.alias("body"))


def heading_sections(files: DataFrame) -> DataFrame:
    """Sections under headings, for texts that begin with one: ``rel, nth, title, body``. Empty bodies are dropped."""
    heads = files.where(F.col("text").rlike(HEADING)).select("rel", F.posexplode(lines(F.col("text"))).alias("at", "line"))
    is_head = F.col("line").rlike(HEADING)
    upto = Window.partitionBy("rel").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = heads.withColumn("nth", F.sum(is_head.cast("int")).over(upto)).withColumn("head", F.when(is_head, strip(F.regexp_extract("line", HEADING, 1))))
    return (
        numbered.groupBy("rel", "nth")
        .agg(F.max("head").alias("title"), F.array_sort(F.collect_list(F.when(~is_head, F.struct("at", "line")))).alias("rows"))
        .select("rel", "nth", F.coalesce("title", F.lit(PREAMBLE)).alias("title"), strip(F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("body"))
        .where(F.length("body") > 0)
    )


def page_sections(files: DataFrame, pages: int = 8) -> DataFrame:
    """Sections of ``pages`` page markers: ``rel, nth, title, body``. What comes before the first marker is left out.

    Texts with fewer than two markers and bodies under forty characters give none.
    """
    marks = F.regexp_extract_all("text", F.lit(PAGE_LINE), F.lit(1))
    # The text between the markers; each marker line is put back in front of its page.
    bodies = F.split("text", PAGE_LINE)
    whole = F.regexp_extract_all("text", F.lit(PAGE_LINE), F.lit(0))
    listed = files.where(F.size(marks) >= 2).select("rel", F.posexplode(F.arrays_zip(marks.alias("page"), whole.alias("mark"), F.slice(bodies, F.lit(2), F.size(marks)).alias("rest"))).alias("at", "p"))
    joined = (
        listed.groupBy("rel", F.floor(F.col("at") / pages).cast("int").alias("nth"))
        .agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("ps"))
        .withColumn("first", F.element_at("ps", 1)["p"]["page"].cast("long"))
        .withColumn("last", F.element_at("ps", -1)["p"]["page"].cast("long"))
        .withColumn("body", strip(F.array_join(F.transform("ps", lambda x: F.concat(x["p"]["mark"], x["p"]["rest"])), "")))
        .where(F.length("body") >= LEAST_PIECE)
    )
    span = F.when(F.col("first") == F.col("last"), F.concat(F.lit("p."), "first")).otherwise(F.concat(F.lit("p."), "first", F.lit("-"), "last"))
    hint = chapter_hint(F.col("body"))
    return joined.select("rel", "nth", F.when(hint.isNotNull(), F.concat(span, F.lit(" · "), hint)).otherwise(span).alias("title"), "body")


def clean_subtitles(files: DataFrame) -> DataFrame:
    """Subtitle texts without headers, numbers, timings and tags; a line equal to the one before it is dropped."""
    rows = files.select("rel", F.posexplode_outer(lines(F.col("text"))).alias("at", "raw")).withColumn("line", strip(F.col("raw")))
    spoken = rows.where((F.length("line") > 0) & (F.col("line") != "WEBVTT") & ~F.col("line").rlike(TIMING) & ~F.col("line").rlike(CUE_NUMBER))
    spoken = spoken.withColumn("line", F.regexp_replace("line", "<[^>]+>", ""))
    before = F.lag("line").over(Window.partitionBy("rel").orderBy("at"))
    kept = spoken.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("line")))
    told = kept.groupBy("rel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda r: r["line"]), "\n").alias("text"))
    return files.select("rel").join(told, "rel", "left").select("rel", F.coalesce("text", F.lit("")).alias("text"))


def sections(files: DataFrame, pages: int = 8) -> DataFrame:
    """``rel, kind, course, series, nth, title, body`` of classified files: books by pages, others by headings, the rest whole."""
    # Each file takes exactly one route, so nothing is computed twice and routes need no anti-joins with large texts.
    timed = F.lower("rel").rlike(r"\.(vtt|srt)$")
    texts = files.where(~timed).select("rel", "text").union(clean_subtitles(files.where(timed)))
    about = texts.withColumn("c", paths.classify(F.col("rel"))).where("c is not null")
    marks = F.size(F.regexp_extract_all("text", F.lit(PAGE_LINE), F.lit(1)))
    paged = (F.col("c.kind") == "book") & (marks >= 2)
    books = page_sections(about.where(paged).select("rel", "text"), pages)
    # A book whose pages are all too short falls back to the other routes.
    bare = about.where(paged).join(books.select("rel").distinct(), "rel", "left_anti")
    others = about.where(~paged).select("rel", "text").union(bare.select("rel", "text"))
    headed = heading_sections(others)
    whole = others.where(~F.col("text").rlike(HEADING)).select("rel", F.lit(0).alias("nth"), paths.stem(F.col("rel")).alias("title"), strip(F.col("text")).alias("body"))
    found = books.union(headed).union(whole.where(F.length("body") > 0))
    return found.withColumn("c", paths.classify(F.col("rel"))).select("rel", "c.*", "nth", "title", "body")


def chunks(found: DataFrame, size: int = 1200, overlap: int = 120, layer: str = "raw") -> DataFrame:
    """The chunk table of sections, without the corpus-wide ``order``; ``ordinal`` counts a file's chunks from 1."""
    pieces = _pieces(found, size, overlap)
    within = Window.partitionBy("rel").orderBy("nth", "piece")
    numbered = pieces.withColumn("ordinal", F.row_number().over(within))
    return numbered.select("rel", "ordinal", *_about(layer))


def _pieces(found: DataFrame, size: int, overlap: int) -> DataFrame:
    return char_window(found, size, overlap, text="body").withColumn("text", strip_column(F.col("body"))).where(F.length("text") >= LEAST_PIECE)


def _about(layer: str) -> list:
    return [paths.chunk_id(F.col("rel"), F.col("ordinal")).alias("id"), "course", "kind", F.lit(layer).alias("layer"), "series", F.col("title").alias("section"), "text"]


def ordered_chunks(found: DataFrame, size: int = 1200, overlap: int = 120, layer: str = "raw") -> DataFrame:
    """``assign_order(chunks(found))`` as a written table, without moving a text.

    Pieces are written where they are cut. Only their paths and numbers are
    dealt by ranges of paths and sorted; what comes of it, two numbers for each
    piece, is broadcast to the texts block by block.
    """
    tables = Tables(found.sparkSession, "chunks")
    cut = _pieces(found, size, overlap).select("rel", "nth", "piece", "course", "kind", "series", "title", "text")
    cut = tables.write(cut.withColumn(PLACE, F.monotonically_increasing_id()), "pieces")
    keys = cut.select(F.split("rel", "/").alias("path"), "nth", "piece", F.col(PLACE).alias("at")).repartitionByRange("path")
    within = Window.partitionBy("path").orderBy("nth", "piece")
    keys = keys.withColumn("ordinal", F.row_number().over(within)).sortWithinPartitions("path", "ordinal").select("at", "ordinal")
    numbers = tables.write(numbered(tables.write(keys.withColumn("place", F.monotonically_increasing_id()), "order")).withColumnRenamed("at", PLACE), "numbers")
    made = (block.select("rel", "ordinal", *_about(layer), "order") for block in in_blocks(cut, numbers))
    made = tables.write_all(made, "chunks")
    tables.drop(cut, numbers)
    return made


def assign_order(rows: DataFrame) -> DataFrame:
    """The corpus-wide ``order`` of ``rel, ordinal`` rows: by path components, then ordinal, from 1.

    Rows are dealt by ranges, sorted within each and written with their places;
    then only the ranges' sizes, one row for each, are summed in one place.
    """
    path = F.split("rel", "/")
    sorted_ = rows.withColumn("path", path).repartitionByRange("path", "ordinal").sortWithinPartitions("path", "ordinal").drop("path")
    return numbered(Tables(rows.sparkSession, "order").write(sorted_.withColumn("place", F.monotonically_increasing_id())))


def numbered(placed: DataFrame) -> DataFrame:
    """Written rows with ``order`` in place of ``place``, which counts the rows of each range in the order wanted."""
    # The number of a row is its range's in the upper bits and its place there in the lower 33.
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", before.alias("before"))
    located = placed.withColumn("part", part).join(F.broadcast(sizes), "part")  # one row for each range
    return located.withColumn("order", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "place", "before")
