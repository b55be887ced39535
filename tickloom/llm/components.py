"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import drop, new_folder, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    # what is joined grows with the edges, so it is never broadcast
    return both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.hint("merge"), "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs → (node, component), component the smallest node.

    Every round is two aggregates and joins over the edges, written as Parquet
    to the shared folder and read from there; the round before is removed, and
    only two counters a round reach the driver.  Nodes without an edge are not
    listed.  Self loops and repeats are ignored.
    """
    spark, folder = edges.sparkSession, new_folder(edges.sparkSession, "components")
    kind = "a long, b long"
    first = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path, seen, rounds = written(first, folder, "0"), None, 0
    while True:
        cur = spark.read.schema(kind).parquet(path)
        mark = cur.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == seen or mark["n"] == 0:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select("b", "b").distinct())
        seen, rounds, before = mark, rounds + 1, path
        path = written(_small_star(_large_star(cur)), folder, str(rounds))
        drop(spark, before)
