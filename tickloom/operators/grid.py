"""Time grids: spines, forward fills, thinning and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spine(df: DataFrame, by: Sequence[str], t: str, step: int) -> DataFrame:
    """Every grid point from the first to the last bucket of each key."""
    ends = df.groupBy(*by).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    return ends.select(*by, F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias(t))


def fill_forward(grid: DataFrame, bars: DataFrame, by: Sequence[str], t: str, value: str) -> DataFrame:
    """The grid with the last value so far, and how it came there."""
    w = Window.partitionBy(*by).orderBy(t)
    d = grid.join(bars.select(*by, t, F.col(value).alias("__v")), [*by, t], "left")
    last = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*by).orderBy(F.desc(t)).rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.last("__v", ignorenulls=True).over(back)
    how = F.when(F.col("__v").isNotNull(), "observed").when(last.isNotNull(), "forward_fill").when(nxt.isNotNull(), "back_fill_initial")
    return d.select(*by, t, F.coalesce(last, nxt).alias(value), how.alias("method"))


def gaps(df: DataFrame, by: Sequence[str], t: str, step: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(t)
    return df.withColumn("__d", F.col(t) - F.lag(t).over(w)).groupBy(*by).agg(F.count_if(F.col("__d") != step).alias("breaks"))


def every_kth(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__n", n).filter(F.pmod(F.col("__n") - 1, F.lit(k)) == 0).drop("__n")


def first_per_bucket(df: DataFrame, by: Sequence[str], t: str, width: int, tie: Sequence[str] = ()) -> DataFrame:
    bucket = F.floor(F.col(t) / width)
    best = F.min_by(F.struct(*df.columns), F.struct(t, *tie))
    return df.groupBy(*by, bucket.alias("__b")).agg(best.alias("__r")).select("__r.*")


def even_sample(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """At most n rows of each key, spread evenly over its order."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    d = df.withColumn("__i", i.cast("long")).withColumn("__t", total)
    slot = lambda x: F.floor(x * n / F.col("__t"))
    return d.filter((F.col("__i") == 0) | (slot(F.col("__i")) != slot(F.col("__i") - 1))).drop("__i", "__t")


def stratified(df: DataFrame, stratum: str, key: str, quota: int, seed: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key))
    return df.withColumn("__n", n).filter(F.col("__n") <= quota).drop("__n")


def zero_filled(configs: DataFrame, dates: DataFrame, facts: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every config on every date, zero where nothing happened; both lists are
    small dimension tables."""
    full = configs.join(dates).join(facts, list(keys), "left")
    return full.withColumns({v: F.coalesce(F.col(v), F.lit(0)) for v in values})
