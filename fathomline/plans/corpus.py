"""The driver's tables in the engine's model: documents as files, benchmark items as questions, embeddings as the vector store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.index import Index
from fathomline.operators.sections import ordered_chunks
from fathomline.sources.tables import version


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a file ``course/<source>/<doc_id>.txt`` of one section."""
    docs = table(spark, sf_dir, "documents")
    rel = F.concat(F.lit("course/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        rel.alias("rel"), F.lit("course").alias("kind"), F.col("source").alias("course"), F.lit(None).cast("string").alias("series"),
        F.lit(0).alias("nth"), F.col("doc_id").cast("string").alias("title"), F.col("text").alias("body"),
    )


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_chunks(document_sections(spark, sf_dir))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))


def embedding_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"))


#: One index for each application and state of its documents.
_INDEXES: dict[tuple, Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the documents, built at the first call and read by all later ones until their files change."""
    key = (spark.sparkContext.applicationId, sf_dir, version(table(spark, sf_dir, "documents")))
    if key not in _INDEXES or not _INDEXES[key].tables.there():
        _INDEXES[key] = Index.build(document_chunks(spark, sf_dir))
    return _INDEXES[key]
