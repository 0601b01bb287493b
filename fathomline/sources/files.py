"""Readers and writers of the engine's tables. Inputs are reached only through Spark's readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathomline.functions.paths import is_source_file
from fathomline.operators.messages import parse_responses
from fathomline.schema import CHUNKS, VECTORS


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """``rel, text`` of all source files under a folder, whatever their depth.

    Bytes that aren't UTF-8 are dropped and line ends become line feeds, which
    no built-in does; hence the small vectorised function.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^([a-z]+):/+", "$1:/")
    plain = base.replace("://", ":/").replace("//", "/")
    rel = F.expr(f"substring(path, length('{plain}') + 1)")
    return files.withColumn("path", path).select(rel.alias("rel"), "content").where(is_source_file(F.col("rel"))).select("rel", F.pandas_udf(_decode, "string")("content").alias("text"))


def _decode(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows from JSON lines; blank lines are skipped, malformed ones are an error, unknown fields are ignored."""
    return spark.read.schema(CHUNKS).option("mode", "FAILFAST").json(path)


def write_chunks(chunks: DataFrame, path: str, json: bool = True) -> None:
    columns = [f.name for f in StructType.fromDDL(CHUNKS).fields]
    rows = chunks.select(*columns)
    rows.write.json(path) if json else rows.write.partitionBy("kind").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(path)


def append_vectors(vectors: DataFrame, path: str) -> None:
    """One more part of the store; a crash between appends loses only the batch at hand."""
    vectors.select("id", F.col("vec").cast("array<float>").alias("vec")).write.mode("append").parquet(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """``qid, q, lang, expect``; a single expectation becomes an array of one. Blank lines are skipped."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return golden(lines)


def golden(lines: DataFrame) -> DataFrame:
    one = "struct<kind:string,course:string,section_contains:string>"
    rows = lines.select(F.xxhash64("value").alias("qid"), F.from_json("value", "q string, lang string, expect string").alias("o"))
    many = F.from_json(F.col("o.expect"), f"array<{one}>")
    single = F.array(F.from_json(F.col("o.expect"), one))
    return rows.select("qid", "o.q", "o.lang", F.when(F.col("o.expect").startswith("["), many).otherwise(single).alias("expect"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return parse_responses(spark.read.text(path))


def write_requests(lines: DataFrame, path: str) -> None:
    """One folder for each shard, each of request lines."""
    lines.select("shard", F.col("line").alias("value")).repartition("shard").write.partitionBy("shard").text(path)


#: Extracts ``(page, text)`` of a PDF's bytes; a library goes here.
PageReader = Callable[[bytes], list[tuple[int, str]]]


def read_pdf_pages(spark: SparkSession, root: str, reader: PageReader) -> DataFrame:
    """``pdf, page, text`` of all PDFs under a folder. A file that the reader refuses has no pages."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(reader(bytes(content)), columns=["page", "text"]).assign(pdf=path)[["pdf", "page", "text"]]

    return files.select("path", "content").mapInPandas(run, "pdf string, page int, text string")


#: Turns texts into vectors; a model or a service goes here.
Embedder = Callable[[list[str]], list[list[float]]]


def embed(rows: DataFrame, make: Callable[[], Embedder], batch: int = 64) -> DataFrame:
    """``id, vec`` of ``id, text`` rows by a model that each task makes once; an empty text is sent as a space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in batches:
            texts = [t or " " for t in frame["text"]]
            vectors = [v for at in range(0, len(texts), batch) for v in model(texts[at : at + batch])]
            yield pd.DataFrame({"id": frame["id"], "vec": vectors})

    return rows.select("id", "text").mapInPandas(run, "id string, vec array<float>")
