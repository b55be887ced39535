"""Sorting, selecting, merging and counting frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact median per key from counts of its different values: the counts are
    made before anything is gathered, and the middle is found by running sums."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*by).orderBy(value)
    placed = counts.withColumn("upto", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("k").over(Window.partitionBy(*by)))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    holds = lambda at: (F.col("upto") - F.col("k") < at) & (F.col("upto") >= at)
    return placed.groupBy(*by).agg(((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias("median"))


def counts_as_json(df: DataFrame, by: Sequence[str], reason: str, name: str) -> DataFrame:
    """value → count per key, as JSON ordered by value."""
    each = df.groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(reason).alias("k"), F.col("n").alias("v"))))
    return each.groupBy(*by).agg(F.to_json(F.map_from_entries(pairs)).alias(name))


def union_parts(*parts: DataFrame) -> DataFrame:
    """Frames one below the other, by name; columns that some lack are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def call_tree(calls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Calls by kind of callee, reverted ones, depth, and a class by ordered rules."""
    of = lambda k: F.count_if(F.col("callee") == k)
    g = calls.groupBy(*by).agg(of("pool").alias("pools"), of("token").alias("tokens"), of("other").alias("others"), F.count_if("reverted").alias("reverts"), F.max("depth").alias("depth"))
    path = F.when(F.col("pools") + F.col("tokens") + F.col("others") == 0, "trace_failed").when(F.col("reverts") > 0, "reverting").when(F.col("pools") > 1, "multi_pool").when(F.col("pools") == 1, "single_pool").otherwise("non_pool")
    return g.withColumn("path", path)


def top_by(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; Spark keeps only those before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def with_sequence(df: DataFrame, day: str, order: Sequence[str], name: str = "seq") -> DataFrame:
    """A dense number over all rows in order: the rows of the days before, and
    the row's place in its day, so that no task sorts more than a day."""
    per_day = df.groupBy(day).agg(F.count(F.lit(1)).alias("n"))  # one row a day
    before = per_day.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy(day).orderBy(*order))
    return df.withColumn("place", place).join(F.broadcast(before), day).withColumn(name, (F.col("before") + F.col("place") - 1).cast("long")).drop("before", "place")


def survivors(rankings: DataFrame, controls: DataFrame, keys: Sequence[str], kinds: int, score: str, control_score: str) -> DataFrame:
    """Rankings for which all ``kinds`` of controls exist and none reaches the score."""
    c = controls.groupBy(*keys).agg(F.count_distinct("control").alias("kinds"), F.max(control_score).alias("best"))
    return rankings.join(c, list(keys)).filter((F.col("kinds") >= kinds) & (F.col("best") < F.col(score))).drop("kinds", "best")


def supported_argmax(df: DataFrame, by: Sequence[str], score: str, support: str, strict: int, loose: int, order: Sequence[str]) -> DataFrame:
    """The best row of each key among those with strict support, else among
    those with loose support."""
    ok = df.filter(F.col(support) >= loose)
    return top_by(ok.withColumn("tier", (F.col(support) < strict).cast("int")), by, [F.col("tier"), F.desc(score), *map(F.col, order)]).drop("rank")
