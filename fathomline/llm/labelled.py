"""Labelled rows, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def labelled_rows(labels: DataFrame, label: str, parts: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """All labelled rows outside the held-out fold: columns ``id, y``.

    Rows without id or label are left out; a repeated row counts once,
    conflicting labels of an id both count.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    return rows.where("id is not null and y in (0, 1)").where(fold("id", parts) != held_out).distinct()


def labelled_sample(labels: DataFrame, label: str, bound: int, parts: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``bound`` of ``labelled_rows``.

    The rows with the smallest hashes of their id are taken, so that the sample
    depends on nothing but the labels.
    """
    return labelled_rows(labels, label, parts, held_out, id_col).orderBy(F.xxhash64("id"), "id", "y").limit(bound)


def placed(rows: DataFrame, by: list[str], *order: str | Column) -> DataFrame:
    """``rows(lot, ...)`` with ``place``, counted from 0 among the rows of the same ``by``: lot after lot, within a lot in this order.

    Only the lots' sizes are summed in one place.
    """
    within = F.row_number().over(Window.partitionBy(*by, "lot").orderBy(*order)) - 1
    sizes = rows.groupBy(*by, "lot").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("lot")) - F.col("n")
    sizes = sizes.select(*by, "lot", before.alias("before"))
    return rows.withColumn("within", within).join(F.broadcast(sizes), [*by, "lot"]).withColumn("place", F.col("within") + F.col("before")).drop("within", "before")
