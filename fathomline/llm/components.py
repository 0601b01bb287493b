"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Component of every node that occurs in ``links(a, b)``: columns ``node, component``.

    Alternates large-star and small-star steps: each moves every node's
    neighbours to the smallest node it sees. Minima are aggregated before they
    are joined back, so a node with very many neighbours is never gathered in a
    task. Each round is written to the shared folder; rounds end when one
    changes nothing, after a number that grows with the logarithm of the longest
    chain. A component's name is its smallest node. Null ends and self-links are
    ignored; no links give no rows.
    """
    edges, mark = _saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), scratch)
    before = None
    while mark[0] and mark != before:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w")).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        done, before = edges, mark
        edges, mark = _saved(small.select("e.u", "e.v").where("u <> v").distinct(), scratch)
        scratch.drop(done)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _saved(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """The written edges, and numbers that tell them from others."""
    table, h = scratch.save(edges), F.xxhash64("u", "v")
    return table, tuple(table.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def with_component(rows: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows(id, class, least, ...)`` with ``component``, the smallest id that the row's class reaches; null for a null id.

    ``links(a, b)`` join classes, whose keys are unique whatever the ids;
    ``least`` is the smallest id in a class. Classes of rows that share an id
    are joined too. The result reads the tables written here.
    """
    known = rows.where("id is not null")
    apart = known.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b")
    versions = known.select("id", F.col("class").alias("b")).join(apart.select("id", "a"), "id").select("a", "b")
    nodes = scratch.save(connected_components(links.select("a", "b").union(versions), scratch))
    named = scratch.save(known.select("class", "least").distinct().join(nodes, F.col("class") == F.col("node")).groupBy("component").agg(F.min("least").alias("smallest")))
    placed = scratch.save(nodes.join(named, "component").select("node", "smallest"))
    found = rows.join(placed, F.col("class") == F.col("node"), "left").withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("smallest", "least")))
    return found.drop("node", "smallest")
