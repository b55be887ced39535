"""Operators composed of the others: prior outcomes, copy edges, settlement,
folds, probes, cost models and market tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import joins as J


def prior_outcomes(entries: DataFrame, outcomes: DataFrame, at: str, by: Sequence[str], y: str, tie: Sequence[str], last: int | None) -> DataFrame:
    """Statistics of the outcomes known at or before each entry's time: the
    last ``last`` of them, or all.  Running statistics in the order in which
    outcomes become known, then one as-of match."""
    w = Window.partitionBy(*by).orderBy(at, *tie)
    f = w.rowsBetween(Window.unboundedPreceding if last is None else 1 - last, 0)
    v = F.col(y)
    stats = {"n": F.count(v), "up": F.sum(F.greatest(v, F.lit(0.0))), "down": F.sum(F.least(v, F.lit(0.0))), "mean": F.avg(v), "worst": F.min(v), "win_rate": F.avg((v > 0).cast("double"))}
    known = outcomes.select(*by, at, F.row_number().over(w).alias("__i"), *(c.over(f).alias(k) for k, c in stats.items()))
    return J.asof_join(entries, known, at, by, list(stats), tie="__i")


def others_latest(kind: str, kinds: Sequence[str], value: Column, w: WindowSpec) -> Column:
    """Mean over the other kinds of their latest value strictly before."""
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.when(F.col(kind) != k, F.last(F.when(F.col(kind) == k, value), ignorenulls=True).over(past)) for k in kinds]
    there = [c.isNotNull().cast("int") for c in latest]
    return S.safe_div(sum((F.coalesce(c, F.lit(0.0)) for c in latest), F.lit(0.0)), sum(there, F.lit(0)))


def coarser(df: DataFrame, by: Sequence[str], t: str, k: int, name: str, value: str, also: Sequence[Column]) -> DataFrame:
    """Buckets of k steps: last value, its log return to the bucket before,
    and further aggregates."""
    b = df.groupBy(*by, F.expr(f"{t} div {k}").alias(name)).agg(F.max_by(value, t).alias("last"), *also)
    return b.withColumn("ret", F.log(S.safe_div(F.col("last"), F.lag("last").over(Window.partitionBy(*by).orderBy(name)))))


def non_overlapping(df: DataFrame, by: Sequence[str], start: str, end: str, tie: Sequence[str]) -> DataFrame:
    """Keep an interval when it starts after the end of the last one kept.

    Each choice depends on the one before, so a key is scanned in order."""

    def scan(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([start, *tie], kind="stable")
        keep, free = [], None
        for a, b in zip(g[start], g[end], strict=True):
            ok = free is None or a > free
            free = b if ok else free
            keep.append(ok)
        return g[keep]

    return df.groupBy(*by).applyInPandas(scan, df.schema)


def settlement(settle: Column, before: Column, strike: Column, stake: Column, fee: Column) -> list[Column]:
    """Above and up/down outcomes, pending without a price, and the profit of
    a stake at even odds."""
    won = settle > strike
    above = F.when(settle.isNull(), "pending").when(won, "won").otherwise("lost")
    move = F.when(settle.isNull() | before.isNull(), "pending").when(settle >= before, "up").otherwise("down")
    profit = F.when(settle.isNotNull(), F.when(won, 2 * stake).otherwise(0.0) - stake - stake * fee)
    return [above.alias("above"), move.alias("move"), F.round(profit, 4).alias("profit")]


def copy_edge(trades: DataFrame, by: Sequence[str], t: str, price: str, delays: Sequence[int]) -> DataFrame:
    """For each delay (above zero, so no trade meets itself): the first price
    after it against the entry's, and the wait in seconds."""
    x = trades.withColumn("delay", F.explode(F.array(*(F.lit(k).cast("long") for k in delays)))).withColumn(t, F.col(t) + F.col("delay"))
    y = J.asof_join(x, trades.select(*by, t, F.col(price).alias("__later")), t, by, ["__later"], forward=True)
    edge = F.col("__later") - F.col(price)
    return y.select("*", edge.alias("edge"), (S.safe_div(F.col("__later"), F.col(price)) - 1).alias("edge_pct"), ((F.col("age") + F.col("delay")) / 1e6).alias("wait_s")).drop("__later")


def purged_folds(df: DataFrame, t: str, folds: Sequence[tuple[int, float, float]], purge: int) -> DataFrame:
    """Rows by fold and part: train up to a share of the span, valid after a
    purge gap up to another share."""
    span = df.agg(F.min(t).alias("__lo"), (F.max(t) - F.min(t)).alias("__w"))  # one row
    table = F.explode(F.array(*(F.struct(F.lit(k).alias("fold"), F.lit(a).alias("__a"), F.lit(b).alias("__b")) for k, a, b in folds))).alias("__f")
    x = df.crossJoin(F.broadcast(span)).select("*", table).select("*", "__f.*")
    train_end, valid_end = (F.col("__lo") + F.col("__w") * F.col(c) for c in ("__a", "__b"))
    part = F.when(F.col(t) <= train_end, "train").when((F.col(t) > train_end + purge) & (F.col(t) <= valid_end), "valid")
    return x.withColumn("part", part).drop("__lo", "__w", "__f", "__a", "__b")


def composite_weights(train: DataFrame, factors: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    """Correlations with the target over the sum of their sizes; equal weights
    where that sum is about zero."""
    c = train.groupBy(*by).agg(*(F.coalesce(F.nanvl(F.corr(f, target), F.lit(None).cast("double")), F.lit(0.0)).alias(f) for f in factors))
    total = sum((F.abs(F.col(f)) for f in factors), F.lit(0.0))
    return c.select(*by, *(F.round(F.when(total < 1e-12, 1 / len(factors)).otherwise(F.col(f) / total), 6).alias(f) for f in factors))


def leak_probes(df: DataFrame, x: str, y: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Correlation of x with the target, with the past target and with the
    target in reversed order.  The reversal is a window too: descending row
    numbers meet ascending ones in an equi-join."""
    w = Window.partitionBy(*by).orderBy(*order)
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    d = df.select(*by, x, y, F.lag(y).over(w).alias("__past"), F.row_number().over(w).alias("__i"), size.alias("__n"))
    back = d.select(*by, (F.col("__n") + 1 - F.col("__i")).alias("__i"), F.col(y).alias("__back"))
    return d.join(back, [*by, "__i"]).groupBy(*by).agg(F.corr(x, y).alias("forward"), F.corr(x, "__past").alias("past"), F.corr(x, "__back").alias("reversed"))


def cost_models(trades: DataFrame, models: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Every trade under each model (name, share of the spread, fee in bps)."""
    m = F.explode(F.array(*(F.struct(F.lit(a).alias("model"), F.lit(s).alias("__s"), F.lit(f).alias("__f")) for a, s, f in models))).alias("__m")
    x = trades.select("*", m).select("*", "__m.*")
    impact = F.when(F.col("__s") > 0, F.least(F.col("spread") * F.col("part"), F.lit(20.0))).otherwise(0.0)
    return x.withColumn("net", F.col("gross") - F.col("__s") * F.col("spread") - F.col("__f") - impact).drop("__m", "__s", "__f")


def lookback_ensemble(signals: DataFrame, by: Sequence[str], lookbacks: int) -> DataFrame:
    n = F.count(F.lit(1))
    return signals.groupBy(*by).agg((n == lookbacks).alias("all_present"), ((F.min("edge") > 0) & (n == lookbacks)).alias("all_positive"), F.min("edge").alias("robust_edge"), F.min("prob").alias("prob_lo"), F.max("prob").alias("prob_hi"))


def basket(legs: DataFrame, by: Sequence[str], lo: str, hi: str, ask: str, tie: Sequence[str]) -> DataFrame:
    """Whether the ranges of an event tile the line, and what all yes and all
    no legs cost."""
    nxt = F.lead(lo).over(Window.partitionBy(*by).orderBy(lo, *tie))
    x = legs.withColumn("__next", nxt)
    n = F.count(F.lit(1))
    return x.groupBy(*by).agg(n.alias("legs"), F.count_if(F.col("__next") > F.col(hi)).alias("n_gaps"), F.count_if(F.col("__next") < F.col(hi)).alias("n_overlaps"), (F.count_if(F.col("__next") != F.col(hi)) == 0).alias("complete"), F.sum(ask).alias("all_yes_cost"), (n - F.sum(ask)).alias("all_no_cost"))
