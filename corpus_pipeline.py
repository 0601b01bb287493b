"""The corpus pipeline: quality, toxicity, near duplicates, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written and read again as the next stage's documents. All but the last return
the columns of the documents.

Defined cases, beside those of each operator: rows with a null id are never
duplicates and stay; of rows that share an id one stays, the one with the
smallest text hash. Empty texts reach the packing, where they have only the
end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.near_duplicates import NearDuplicates
from fathomline.llm.packing import BestFitPacker
from fathomline.llm.quality import QualityClassifier
from fathomline.llm.queries import byte_bpe_path, table
from fathomline.llm.secret_scan import SecretScanner
from fathomline.llm.storage import Scratch
from fathomline.llm.toxicity import ToxicityClassifier


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of accepted quality."""
    classifier = QualityClassifier()
    return classifier.keep(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't judged toxic."""
    classifier = ToxicityClassifier()
    return classifier.keep(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    kept = NearDuplicates().find(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("d"), F.col("doc_id").cast("long").alias("kept_id"))
    one = Window.partitionBy("kept_id").orderBy(F.xxhash64("d.text"))
    unique = rows.where("kept_id is not null").join(kept, "kept_id", "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1")
    return unique.select("d.*").union(rows.where("kept_id is null").select("d.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return SecretScanner().redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised pieces of all documents and their places in the training sequences."""
    return BestFitPacker(byte_bpe_path()).pack(docs)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packing),
]

#: Learned scores and hash sketches have no SQL form; tests hold the operators of the stages against brute force, held-out labels or round trips.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
