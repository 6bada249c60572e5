"""Connected components of an edge table by alternating stars: each round hangs neighbours on the least node that is
seen, first the greater ones, then the lesser ones, until nothing moves. Edges of every round are stored in the shared
folder; a node with very many edges meets only its own minimum, which partial aggregation finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_folder, written


def _hung(pairs: DataFrame) -> DataFrame:
    """(a, b) -> (b, least of all b of a, and a itself)."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(least, "a")


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge. ``edges``: (a, b), any order."""
    spark = edges.sparkSession
    folder = folder or shared_folder(spark)
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/0")
    step, seen = 0, None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _hung(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = _hung(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step += 1
        now = written(small, f"{folder}/{step}")
        sign = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        remove(spark, f"{folder}/{step - 1}")
        if sign == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = sign
