"""Messages in and out: commands, splitting, batches of requests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fathomline.functions.text import strip
from fathomline.sources.tables import Tables

# The commands and their other spellings, the length of a message, the rows of a lane that are batched in one go, and the lines of a request file.
HELP = ("/help", "help", "帮助", "?", "？")
COURSES = ("/courses", "/course", "courses")
MESSAGE_LIMIT = 1500
STRETCH = 512
REQUEST_LINES = 40_000
ENDPOINT = "/v1/embeddings"


def route(text: Column) -> Column:
    """``struct<action, argument>`` of a chat message. Commands are matched by their beginning."""
    t = strip(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    said = lambda name, cut: F.struct(F.lit(name).alias("action"), (strip(t.substr(F.lit(cut + 1), F.length(t))) if cut else F.lit("")).alias("argument"))
    return (
        F.when((t == "") | low.isin(*HELP), said("help", 0))
        .when(low.isin(*COURSES), said("courses", 0))
        .when(low.startswith("/use"), said("use", 4))
        .when(low.startswith("/whoami"), said("whoami", 0))
        .when(low.startswith("/teach"), said("teach", 6))
        .otherwise(F.struct(F.lit("ask").alias("action"), t.alias("argument")))
    )


def split_message(text: Column, limit: int = MESSAGE_LIMIT) -> Column:
    """Parts of at most ``limit`` characters: paragraphs are packed while they fit, longer ones are cut."""
    paragraphs = F.split(text, "\n\n")
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(s: Column, p: Column) -> Column:
        joined = F.when(s["buf"] == "", p).otherwise(F.concat(s["buf"], F.lit("\n\n"), p))
        flushed = F.when(s["buf"] == "", s["out"]).otherwise(F.array_append(s["out"], s["buf"]))
        # A paragraph that is too long leaves its last, not empty part in the buffer.
        full = F.greatest(F.ceil(F.length(p) / limit).cast("int") - 1, F.lit(0))
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(full - 1, F.lit(0))), lambda i: p.substr(i * limit + 1, F.lit(limit)))
        cut = F.when(full > 0, F.concat(flushed, pieces)).otherwise(flushed)
        rest = p.substr(full * limit + 1, F.lit(limit))
        return F.when(F.length(joined) <= limit, F.struct(s["out"].alias("out"), joined.alias("buf"))).otherwise(F.struct(cut.alias("out"), rest.alias("buf")))

    folded = F.aggregate(paragraphs, state, step, lambda s: F.when(s["buf"] == "", s["out"]).otherwise(F.array_append(s["out"], s["buf"])))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(folded)


def pack_batches(rows: DataFrame, budget: int, most: int) -> DataFrame:
    """Greedy batches within a lane: ``lane, pos, batch`` from ``lane, pos, text``.

    A text counts up to the budget; a batch closes when the next text would pass
    the budget or ``most`` texts are in it. Which batch a row begins depends on
    its place and the running sum of sizes alone, so no lane is folded in one
    task: places and sums are counted in two levels, stretches of a lane tell
    where a chain leaves them for each row it can enter at, and the entries met
    from a lane's first row are found by pointer doubling.
    """
    spark = rows.sparkSession
    scratch = Tables(spark, "batches")
    # No batch has more rows than this, so a chain enters a stretch among its first ``reach`` rows and never skips one.
    reach = min(most, budget)
    stretch = max(STRETCH, reach)
    kinds = {f.name: f.dataType for f in rows.select("lane", "pos").schema}

    size = F.least(F.greatest(F.length(F.coalesce("text", F.lit(" "))), F.when(F.coalesce("text", F.lit("")) == "", 1).otherwise(0)), F.lit(budget))
    # Rows of one pos are told apart by ``row``; it is written, so that no later reading numbers them anew.
    sized = scratch.write(rows.select("lane", "pos", size.cast("long").alias("size"), F.monotonically_increasing_id().alias("row")))
    by = ("lane", "pos", "size", "row")
    lots = sized.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).withColumn("lot", F.spark_partition_id())
    within = Window.partitionBy("lane", "lot").orderBy(*by[1:])
    counted = lots.select("lane", "pos", "size", "lot", (F.row_number().over(within) - 1).cast("long").alias("at"), (F.sum("size").over(within) - F.col("size")).alias("ahead"))
    counted = scratch.write(counted)
    # One row for each lot of a lane.
    totals = counted.groupBy("lane", "lot").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    earlier = Window.partitionBy("lane").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    totals = totals.select(F.col("lane").alias("t_lane"), F.col("lot").alias("t_lot"), before("n").alias("n"), before("chars").alias("chars"))
    joined = counted.join(totals, F.col("lane").eqNullSafe(F.col("t_lane")) & (F.col("lot") == F.col("t_lot")))
    at = F.col("at") + F.col("n")
    placed = scratch.write(joined.select("lane", "pos", "size", at.alias("at"), (F.col("ahead") + F.col("chars")).alias("ahead"), F.floor(at / stretch).cast("long").alias("stretch")))
    scratch.drop(sized, counted)

    # A stretch also sees the first rows of the next one, where its last batches end.
    last = (F.col("stretch") > 0) & (F.col("at") - F.col("stretch") * stretch < reach)
    seen = placed.select("lane", "size", "at", "ahead", F.explode(F.when(last, F.array("stretch", F.col("stretch") - 1)).otherwise(F.array("stretch"))).alias("stretch"))
    ways = T.StructType([T.StructField("lane", kinds["lane"]), *(T.StructField(c, T.LongType()) for c in ("node", "to", "n"))])
    jumps = scratch.write(seen.groupBy("lane", "stretch").applyInArrow(_ways(budget, most, reach, stretch), ways))

    # ``met`` holds the first 2^k entries of each lane's chain and ``jumps`` leads 2^k entries on, so what it adds is new.
    met = scratch.write(jumps.where("node = 0").select("lane", "node", F.lit(0).cast("long").alias("before")))
    while True:
        step = jumps.select(F.col("lane").alias("j_lane"), F.col("node").alias("j_node"), "to", "n").where("to is not null")
        added = met.join(step, F.col("lane").eqNullSafe(F.col("j_lane")) & (F.col("node") == F.col("j_node")))
        added = scratch.write(added.select("lane", F.col("to").alias("node"), (F.col("before") + F.col("n")).alias("before")))
        if added.isEmpty():
            break
        more = jumps.where("to is not null").alias("a").join(step.alias("b"), F.col("a.lane").eqNullSafe(F.col("b.j_lane")) & (F.col("a.to") == F.col("b.j_node")))
        further = scratch.write(more.select("a.lane", "a.node", F.col("b.to").alias("to"), (F.col("a.n") + F.col("b.n")).alias("n")))
        longer = scratch.write(met.union(added))
        scratch.drop(jumps, met, added)
        jumps, met = further, longer

    entry = met.select(F.col("lane").alias("e_lane"), F.floor(F.col("node") / stretch).cast("long").alias("e_stretch"), F.col("node").alias("entry"), "before")
    entered = placed.join(entry, F.col("lane").eqNullSafe(F.col("e_lane")) & (F.col("stretch") == F.col("e_stretch")))
    told = T.StructType([T.StructField("lane", kinds["lane"]), T.StructField("pos", kinds["pos"]), T.StructField("batch", T.LongType())])
    batches = entered.select("lane", "stretch", "pos", "size", "at", "ahead", "entry", "before").groupBy("lane", "stretch").applyInArrow(_numbered(budget, most), told)
    return batches.select("lane", F.col("pos").cast("long").alias("pos"), F.col("batch").cast("int").alias("batch"))


def _nexts(part: pa.Table, budget: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a stretch's rows, which are in order, and where the batch that each begins ends, as far as the rows tell."""
    at, ahead, size = (part.column(c).to_numpy() for c in ("at", "ahead", "size"))
    edges = np.append(ahead, ahead[-1] + size[-1])
    ends = at[0] + np.searchsorted(edges, ahead + budget, side="right") - 1
    return at, np.minimum(ends, at + most)


def _ways(budget: int, most: int, reach: int, stretch: int):
    """For each row at which a chain can enter a stretch: the entry of the next one, null where no rows follow, and the batches begun on the way."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        at, ends = _nexts(part, budget, most)
        first = int(at[0])
        edge, stop = (first // stretch + 1) * stretch, int(at[-1]) + 1
        out, n = ends.copy(), np.ones(len(at), np.int64)
        for i in range(min(len(at), edge - first) - 1, -1, -1):
            if (j := int(ends[i])) < min(edge, stop):
                out[i], n[i] = out[j - first], n[j - first] + 1
        k = min(reach, len(at), edge - first)
        # The lane's end is an entry too where rows of the next stretch belong to a batch that began here.
        to = pa.array(out[:k], pa.int64(), mask=(out[:k] >= stop) & (stop <= edge))
        return pa.table({"lane": part.column("lane").slice(0, k), "node": at[:k], "to": to, "n": n[:k]})

    return run


def _numbered(budget: int, most: int):
    """The rows of a stretch with their batches; those before its entry belong to the last batch of the stretch before."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        at, ends = _nexts(part, budget, most)
        begins, i = np.zeros(len(at), np.int64), part.column("entry")[0].as_py() - int(at[0])
        while i < len(at):
            begins[i] = 1
            i = int(ends[i]) - int(at[0])
        batch = part.column("before")[0].as_py() + np.cumsum(begins) - 1
        return pa.table({"lane": part.column("lane"), "pos": part.column("pos"), "batch": batch})

    return run


def request_lines(chunks: DataFrame, model: str, per_file: int = REQUEST_LINES) -> DataFrame:
    """``shard, custom_id, line``: request files for an embedding service, in order of ``order``."""
    text = F.when(F.coalesce("text", F.lit("")) == "", F.lit(" ")).otherwise(F.col("text"))
    line = F.to_json(F.struct(F.col("id").alias("custom_id"), F.lit("POST").alias("method"), F.lit(ENDPOINT).alias("url"), F.struct(F.lit(model).alias("model"), text.alias("input")).alias("body")))
    return chunks.select(F.floor((F.col("order") - 1) / per_file).cast("long").alias("shard"), F.col("id").alias("custom_id"), line.alias("line"))


def parse_responses(lines: DataFrame) -> DataFrame:
    """``id, vec`` of an embedding service's response lines ``value``; failed ones are left out."""
    schema = "custom_id string, error string, response struct<status_code:int, body:struct<data:array<struct<embedding:array<double>>>>>"
    o = lines.where(F.length(F.trim("value")) > 0).select(F.from_json("value", schema).alias("o")).where("o.error is null and o.response.status_code = 200")
    return o.select(F.col("o.custom_id").alias("id"), F.get(F.col("o.response.body.data"), F.lit(0))["embedding"].alias("vec"))


def pdf_decision(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """``pdf, pages, text_pages, chars, needs_ocr`` from ``pdf, page, text``."""
    # Characters of a page with text, the least share of such pages, and the least characters of a book.
    per_page, share, total = 10, 0.6, 500
    text = strip(F.coalesce("text", F.lit("")))
    full = F.length(text) >= per_page
    found = pages.groupBy("pdf").agg(
        F.count("*").alias("pages"), F.count_if(full).alias("text_pages"), F.coalesce(F.sum(F.when(full, F.length(text))), F.lit(0)).cast("long").alias("chars")
    )
    auto = (F.col("text_pages") / F.col("pages") < share) | (F.col("chars") < total)
    return found.withColumn("needs_ocr", F.lit(True) if mode == "force" else F.lit(False) if mode == "off" else auto)


def join_pages(pages: DataFrame, mark: bool = True) -> DataFrame:
    """``pdf, text``: a document's pages under their markers; blank pages are left out."""
    text = strip(F.coalesce("text", F.lit("")))
    shown = F.concat(F.lit("[p."), F.col("page").cast("string"), F.lit("]\n"), text) if mark else text
    listed = pages.groupBy("pdf").agg(F.array_sort(F.collect_list(F.when(F.length(text) > 0, F.struct("page", shown.alias("body"))))).alias("ps"))
    return listed.select("pdf", F.array_join(F.transform("ps", lambda p: p["body"]), "\n\n").alias("text"))
