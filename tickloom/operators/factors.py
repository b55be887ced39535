"""Factor tests: ranks, buckets, correlations, splits and controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import safe_div, unit_hash


def average_rank(x: str, by: Sequence[str]) -> Column:
    """Tied values share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2


def value_slice(x: Column, parts: int = 1024) -> Column:
    """A whole number that ascends with a finite x: ``parts`` slices between
    two powers of two, so that rows spread whatever the scale of their values."""
    size = F.greatest(F.abs(x.cast("double")), F.lit(1e-300))
    power = F.floor(F.log2(size))
    part = F.greatest(F.lit(0), F.least(F.floor((size / F.pow(F.lit(2.0), power) - 1) * parts), F.lit(parts - 1)))
    return F.when(x == 0, 0).otherwise(F.signum(x) * ((power + 1100) * parts + part + 1)).cast("long")


def with_ranks(df: DataFrame, x: str, by: Sequence[str], rank: str | None, tie: Sequence[str] = (), place: str | None = None, total: str | None = None) -> DataFrame:
    """Average ranks of x per key, and where asked for the place in (x, tie)
    order from 0 and the number of rows.  Rows are put in order inside slices of
    the values only; the rows of the slices before are added from counts, so
    that no task sorts a whole key."""
    d = df.withColumn("value_slice", value_slice(F.col(x)))
    counts = d.groupBy(*by, "value_slice").agg(F.count(F.lit(1)).alias("in_slice"))
    key = Window.partitionBy(*by)
    before = F.coalesce(F.sum("in_slice").over(key.orderBy("value_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "value_slice", before.alias("before_slice"), F.sum("in_slice").over(key).alias("rows_of_key"))
    inside = Window.partitionBy(*by, "value_slice")
    new = {rank: average_rank(x, [*by, "value_slice"])} if rank else {}
    if place:
        new[place] = F.row_number().over(inside.orderBy(x, *tie)) - 1
    d = d.withColumns(new).join(counts, [*by, "value_slice"])
    moved = {c: F.col(c) + F.col("before_slice") for c in new} | ({total: F.col("rows_of_key")} if total else {})
    return d.withColumns(moved).drop("value_slice", "before_slice", "rows_of_key")


def _correlation(x: str, y: str) -> Column:
    return F.when(F.count(F.lit(1)) >= 2, safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _correlation(x, y).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("x_value"), F.col(y).alias("y_value"))
    d = with_ranks(with_ranks(d, "x_value", by, "x_rank"), "y_value", by, "y_rank")
    return pearson(d, "x_rank", "y_rank", by).withColumnRenamed("pearson", "spearman")


def equal_buckets(df: DataFrame, x: str, by: Sequence[str], tie: Sequence[str], k: int) -> DataFrame:
    """floor(position · k / n) over (value, tie)."""
    w = Window.partitionBy(*by)
    pos = F.row_number().over(w.orderBy(x, *tie)) - 1
    return df.withColumn("bucket", F.floor(pos * k / F.count(F.lit(1)).over(w)).cast("int"))


def quantile_cuts(df: DataFrame, x: str, by: Sequence[str], qs: Sequence[float]) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile(x, F.array(*map(F.lit, qs))).alias("cuts"))


def cut_buckets(df: DataFrame, x: str, by: Sequence[str], k: int) -> DataFrame:
    """Linear quantile edges with repeats dropped; bucket = edges below x."""
    cuts = quantile_cuts(df, x, by, [i / k for i in range(1, k)])
    d = df.join(cuts, list(by))
    return d.withColumn("bucket", F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col(x)))).drop("cuts")


def long_form(df: DataFrame, ids: Sequence[str], factors: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """One row per (id, factor, target) with both values."""
    f = df.unpivot([*ids, *targets], list(factors), "factor", "x")
    return f.unpivot([*ids, "factor", "x"], list(targets), "target", "y")


def factor_tests(df: DataFrame, ids: Sequence[str], factors: Sequence[str], targets: Sequence[str], k: int = 3, least: int = 30) -> DataFrame:
    """Per factor and target: n, both correlations, and the mean target of the
    lowest and highest bucket."""
    by = ["factor", "target"]
    d = long_form(df, ids, factors, targets).dropna(subset=["x", "y"])
    d = with_ranks(d, "x", by, "x_rank", [*ids, "y"], "place", "of")
    d = with_ranks(d.drop(*ids), "y", by, "y_rank").withColumn("bucket", F.floor(F.col("place") * k / F.col("of")))
    mean_in = lambda b: F.avg(F.when(F.col("bucket") == b, F.col("y")))
    t = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _correlation("x", "y").alias("pearson"), _correlation("x_rank", "y_rank").alias("spearman"), mean_in(0).alias("low_mean"), mean_in(k - 1).alias("high_mean"), F.avg((F.col("y") > 0).cast("double")).alias("positive_rate"))
    return t.filter(F.col("n") >= least).withColumn("spread", F.col("high_mean") - F.col("low_mean"))


def chronological_split(df: DataFrame, day: str, discovery: float = 0.6, validation: float = 0.8) -> DataFrame:
    """Distinct dates in order → discovery, validation, forward.  The window
    runs over the distinct dates only."""
    days = df.select(day).distinct()
    n, total = F.row_number().over(Window.orderBy(day)), F.count(F.lit(1)).over(Window.partitionBy())
    name = F.when(n <= F.floor(total * discovery), "discovery").when(n <= F.floor(total * validation), "validation").otherwise("forward")
    return df.join(days.withColumn("split", name), day)


def auc(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Rank-sum AUC with half ties, and the share of pairs in order."""
    d = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("__r", average_rank(score, by))
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    rank_sum = F.sum(F.when(F.col(label) == 1, F.col("__r")))
    return d.groupBy(*by).agg(pos.alias("positives"), neg.alias("negatives"), safe_div(rank_sum - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def expected_shortfall(df: DataFrame, x: str, by: Sequence[str], alpha: float) -> DataFrame:
    """Mean of the ceil(alpha · n) smallest values."""
    d = with_ranks(df.dropna(subset=[x]).select(*by, x), x, by, None, place="place", total="total")
    return d.filter(F.col("place") < F.ceil(F.col("total") * alpha)).groupBy(*by).agg(F.avg(x).alias("tail_mean"))


def trimmed_mean(df: DataFrame, x: str, by: Sequence[str], alpha: float) -> DataFrame:
    """Mean without the ceil(alpha · n) largest values."""
    d = with_ranks(df.dropna(subset=[x]).select(*by, x), x, by, None, place="place", total="total")
    kept = F.when(F.col("total") - F.col("place") > F.ceil(F.col("total") * alpha), F.col(x))
    return d.groupBy(*by).agg(F.avg(kept).alias("trimmed_mean"))


def mad(df: DataFrame, x: str, by: Sequence[str], floor: float = 1e-9) -> DataFrame:
    med = df.groupBy(*by).agg(F.median(x).alias("__m"))
    return df.join(med, list(by)).groupBy(*by).agg(F.greatest(F.median(F.abs(F.col(x) - F.col("__m"))), F.lit(floor)).alias("mad"))


def leave_one_out_min(df: DataFrame, x: str, group: str, by: Sequence[str]) -> DataFrame:
    g = df.groupBy(*by, group).agg(F.sum(x).alias("s"), F.count(x).alias("n"))
    w = Window.partitionBy(*by)
    rest = safe_div(F.sum("s").over(w) - F.coalesce("s", F.lit(0.0)), F.sum("n").over(w) - F.col("n"))
    return g.withColumn("__r", rest).groupBy(*by).agg(F.min("__r").alias("min_mean"))


def hash_sign(df: DataFrame, key: str, x: str, seed: int) -> DataFrame:
    """The control whose sign a hash decides."""
    return df.withColumn("control", F.when(unit_hash(seed, F.col(key)) < 0.5, -F.col(x)).otherwise(F.col(x)))


def shuffle_within(df: DataFrame, by: Sequence[str], order: Sequence[str], x: str, seed: int) -> DataFrame:
    """x permuted inside each key by a hash; same multiset, same reruns."""
    a = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    h = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *order), *order)
    b = df.withColumn("__n", F.row_number().over(h)).select(*by, "__n", F.col(x).alias("shuffled"))
    return a.join(b, [*by, "__n"]).drop("__n")


def bootstrap_mean(df: DataFrame, x: str, key: str, by: Sequence[str], iterations: int, seed: int) -> DataFrame:
    """5/50/95 percentiles of means under Poisson(1) weights drawn by hash."""
    u = unit_hash(seed, F.col(key), F.col("it"))
    w = F.lit(0)
    total, p = 0.0, 0.36787944117144233
    for k in range(1, 9):
        total, p = total + p, p / k
        w = w + (u >= total).cast("int")
    d = df.dropna(subset=[x]).withColumn("it", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("__w", w)
    means = d.groupBy(*by, "it").agg(safe_div(F.sum(F.col("__w") * F.col(x)), F.sum("__w")).alias("m"))
    return means.groupBy(*by).agg(F.percentile("m", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"), F.avg((F.col("m") > 0).cast("double")).alias("p_positive"))
