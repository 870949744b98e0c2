"""Connected components of a graph of edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowframe.llm.durable import durable


def _least(edges: DataFrame) -> DataFrame:
    """The least smaller neighbour of each node that has one; edges run from the larger node a to the smaller b."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


#: Edges of a file, about, and files at least.
FILE_EDGES, LEAST_FILES = 1 << 17, 8


def components(edges: DataFrame, n_nodes: int) -> DataFrame:
    """node, root: every node of ``edges`` (a, b: long) and the least node of its component.

    Each round hangs every node's larger neighbours, then its smaller ones, onto the least node next to it; rounds grow
    with the logarithm of the longest path. The edges of a round, and what a hub is joined with, are kept as files: a
    lost executor costs no earlier round, and a hub's edges may be split over tasks. The files are as many as about
    ``n_nodes`` nodes ask for, however many partitions a shuffle has. Loops and repeats are allowed.
    """
    files = max(LEAST_FILES, n_nodes // FILE_EDGES)
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(files))
    sign = None
    while True:
        least = durable(_least(now).coalesce(files)).select(F.col("a").alias("b"), "m")
        large = now.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        pulled = large.join(_least(large), "a").select("a", "b", "m")
        small = pulled.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        now = durable(small.where("a <> b").distinct().coalesce(files))
        last, sign = sign, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last == sign:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
