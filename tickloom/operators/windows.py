"""Lag, rolling, expanding and recursive columns per key, past only."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.scalars import safe_div


def ordered(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def rows(w: WindowSpec, a: int | None, b: int | None) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding if a is None else a, Window.unboundedFollowing if b is None else b)


def log_return(price: Column, w: WindowSpec, scale: float = 1.0) -> Column:
    """Against the last positive price before, so that gaps are bridged."""
    prev = F.last(F.when(price > 0, price), ignorenulls=True).over(rows(w, None, -1))
    return F.when(price > 0, F.log(price / prev) * scale)


_FOLDS = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def rolled(df: DataFrame, by: Sequence[str], order: Sequence[str], sizes: Sequence[int], folds: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` and, for each size n and each of ``folds`` (a sum, max or min of a
    column), ``{name}_last_{n}`` over the last n rows, this one included, and
    ``{name}_past_{n}`` over the n rows before it; sums of nothing are 0.

    Rows are cut into blocks of n: a frame is the end of one block and the start
    of the next, each a running fold.  A row costs the same whatever n, and
    nothing is taken away from a sum.  ``order`` must tell the rows of a key apart.
    """
    d = df.withColumn("row_place", F.row_number().over(ordered(by, order)) - 1).withColumns({f"part_{name}": c.cast("double") for name, (_, c) in folds.items()})
    place, out = Window.partitionBy(*by).orderBy("row_place"), []
    for n in sizes:
        d = d.withColumn(f"block_{n}", F.floor(F.col("row_place") / n))
        block = Window.partitionBy(*by, f"block_{n}")
        here, behind = rows(block.orderBy("row_place"), None, 0), rows(block.orderBy(F.desc("row_place")), None, 0)
        runs = {}
        for name, (kind, _) in folds.items():
            runs |= {f"start_{name}_{n}": _FOLDS[kind][0](f"part_{name}").over(here), f"end_{name}_{n}": _FOLDS[kind][0](f"part_{name}").over(behind)}
        d = d.withColumns(runs)
        first, last = F.col("row_place") % n == 0, F.col("row_place") % n == n - 1
        both = {}
        for name, (kind, _) in folds.items():
            join, start, end = _FOLDS[kind][1], F.col(f"start_{name}_{n}"), F.col(f"end_{name}_{n}")
            both[f"{name}_last_{n}"] = join(F.when(~last, F.lag(end, n - 1).over(place)), start)
            both[f"{name}_past_{n}"] = join(F.lag(end, n).over(place), F.when(~first, F.lag(start, 1).over(place)))
        out += both
        d = d.withColumns(both)
    return d.select(*df.columns, *out)


def past_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, sums: dict[str, Column]) -> DataFrame:
    """``df`` and, for each of ``sums``, its sum over the ``n`` rows before, 0
    where there are none."""
    d = rolled(df, by, order, [n], {name: ("sum", c) for name, c in sums.items()})
    return d.select(*df.columns, *(F.col(f"{name}_past_{n}").alias(name) for name in sums))


def past_std(x: Column, w: WindowSpec, n: int, least: int = 2) -> Column:
    f = rows(w, -n, -1)
    return F.when(F.count(x).over(f) >= least, F.stddev_pop(x).over(f))


def realised_vol(ret: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    f = rows(w, -(n - 1), 0)
    return F.when(F.count(ret).over(f) >= (min(n, 15) if least is None else least), F.sqrt(F.sum(ret * ret).over(f)))


def zscore(x: Column, w: WindowSpec, n: int, least: int = 5, inclusive: bool = False) -> Column:
    f = rows(w, -(n - 1), 0) if inclusive else rows(w, -n, -1)
    sd = F.stddev_pop(x).over(f)
    return F.when((F.count(x).over(f) >= least) & (sd > 0), (x - F.avg(x).over(f)) / sd)


def robust_z(x: Column, w: WindowSpec, n: int, least: int = 5) -> Column:
    f = rows(w, -(n - 1), 0)
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(f)
    return F.when(F.count(x).over(f) >= least, (x - q[1]) / F.greatest(q[2] - q[0], F.lit(1e-9)))


def contiguous_sum(x: Column, minute: Column, w: WindowSpec, n: int, step: int = 60) -> Column:
    """Only over n rows without a gap or null."""
    f = rows(w, -(n - 1), 0)
    return F.when((F.count(x).over(f) == n) & (minute - F.min(minute).over(f) == (n - 1) * step), F.sum(x).over(f))


def rolling_beta(y: Column, x: Column, w: WindowSpec, n: int, least: int | None = None) -> tuple[Column, Column]:
    f = rows(w, -(n - 1), 0)
    pairs = F.count(x + y).over(f)
    k = min(n, 30) if least is None else least
    cov, sx, sy = F.covar_pop(y, x).over(f), F.stddev_pop(x).over(f), F.stddev_pop(y).over(f)
    return F.when(pairs >= k, safe_div(cov, sx * sx)), F.when(pairs >= k, safe_div(cov, sx * sy))


def time_frame(by: Sequence[str], ts_us: str, lo: int, hi: int) -> WindowSpec:
    """[t + lo, t + hi] in the unit of the numeric time."""
    return Window.partitionBy(*by).orderBy(ts_us).rangeBetween(lo, hi)


def signed_memory(x: Column, f: WindowSpec) -> dict[str, Column]:
    p, n = F.sum(F.greatest(x, F.lit(0.0))).over(f), F.sum(F.greatest(-x, F.lit(0.0))).over(f)
    return {"net": p - n, "balance": safe_div(p - n, F.sqrt(p + n)), "signed_total": F.signum(p - n) * (p + n)}


def impulse_decay(x: Column, w: WindowSpec, n: int, scale: float = 2.0) -> Column:
    """Exponentially weighted mean of the last n values, newest first."""
    weights = [float(np.exp(-k / scale)) for k in range(n)]
    total = sum((F.coalesce(F.lag(x, k).over(w), F.lit(0.0)) * weights[k] for k in range(n)), F.lit(0.0))
    return F.when(F.count(x).over(rows(w, -(n - 1), 0)) == n, total / sum(weights))


def run_length(df: DataFrame, flag: str, by: Sequence[str], order: Sequence[str], cap: int | None = None, name: str = "run") -> DataFrame:
    """Consecutive rows with the flag, ending at this one."""
    w = ordered(by, order)
    d = df.withColumn("__i", F.sum(F.when(F.coalesce(F.col(flag), F.lit(False)), 0).otherwise(1)).over(rows(w, None, 0)))
    n = F.count_if(F.coalesce(F.col(flag), F.lit(False))).over(rows(Window.partitionBy(*by, "__i").orderBy(*order), None, 0))
    return d.withColumn(name, F.least(n, F.lit(cap)) if cap else n).drop("__i")


def sign_changes(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], n: int, name: str = "sign_changes") -> DataFrame:
    """Flips of sign in the last n rows; zeros keep the sign before."""
    w = ordered(by, order)
    s = F.last(F.when(F.col(x) != 0, F.signum(x)), ignorenulls=True).over(rows(w, None, 0))
    d = df.withColumn("__s", s)
    d = d.withColumn("__f", F.coalesce((F.col("__s") != F.lag("__s").over(w)).cast("int"), F.lit(0)))
    return d.withColumn(name, F.sum("__f").over(rows(w, -(n - 1), 0))).drop("__s", "__f")


def cusum(df: DataFrame, ret: str, by: Sequence[str], order: Sequence[str], drift: float, threshold: float) -> DataFrame:
    """g = max(0, g + r - drift) in closed form; a null return leaves g."""
    w = rows(ordered(by, order), None, 0)
    d = df.withColumn("__s", F.sum(F.coalesce(F.col(ret) - drift, F.lit(0.0))).over(w))
    g = F.col("__s") - F.least(F.lit(0.0), F.min("__s").over(w))
    return d.withColumn("cusum", g).withColumn("cusum_flag", F.col("cusum") > threshold).drop("__s")


def hysteresis(df: DataFrame, flag: str, by: Sequence[str], order: Sequence[str], on: int, off: int) -> DataFrame:
    """On after ``on`` consecutive true rows, off after ``off`` false ones."""
    d = run_length(df, flag, by, order, name="__up").withColumn("__not", ~F.coalesce(F.col(flag), F.lit(False)))
    d = run_length(d, "__not", by, order, name="__down")
    event = F.when(F.col("__up") >= on, True).when(F.col("__down") >= off, False)
    w = ordered(by, order)
    d = d.withColumn("active", F.coalesce(F.last(event, ignorenulls=True).over(rows(w, None, 0)), F.lit(False)))
    return d.withColumn("starts", F.col("active") & ~F.coalesce(F.lag("active").over(w), F.lit(False))).drop("__up", "__down", "__not")


def rsi(ret: Column, w: WindowSpec, n: int) -> Column:
    f = rows(w, -(n - 1), 0)
    part = lambda x: F.avg(F.when(ret.isNotNull(), F.greatest(x, F.lit(0.0)))).over(f)
    up, down = part(ret), part(-ret)
    return F.when(F.count(ret).over(f) == 0, 50.0).when(down == 0, F.when(up == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + up / down))


def max_drawdown(df: DataFrame, pnl: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = rows(ordered(by, order), None, 0)
    d = df.withColumn("__e", F.sum(pnl).over(w)).withColumn("__p", F.greatest(F.max("__e").over(w), F.lit(0.0)))
    return d.groupBy(*by).agg(F.max(F.col("__p") - F.col("__e")).alias("max_drawdown"), F.sum(pnl).alias("total"))


def keyed_scan(df: DataFrame, by: Sequence[str], order: Sequence[str], schema, fold: Callable) -> DataFrame:
    """``fold(rows, state) → (rows, state)`` over each key in order.  Rows come
    sorted, batch by batch, and the state goes on from one batch to the next,
    so a task holds one batch however long a key's history is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            keys = list(zip(*(pdf[c].tolist() for c in by), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            out = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                rows_, state = fold(pdf.iloc[i:j], state if keys[i] == last else None)
                last = keys[i]
                out.append(rows_)
            yield pd.concat(out)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def recursive_filter(df: DataFrame, by: Sequence[str], order: Sequence[str], x: str, decay: float = 0.82, gain: float = 0.18, tanh: bool = False) -> DataFrame:
    """y = decay·y + gain·x, or with tanh(x − y); from 0, a null x counting as 0."""
    keep = [*dict.fromkeys([*by, *order])]
    schema = df.select(*keep).schema.add("y", "double")

    def fold(pdf: pd.DataFrame, y: float | None) -> tuple[pd.DataFrame, float]:
        y, out = y or 0.0, []
        for v in pdf[x].fillna(0.0).tolist():
            y = decay * y + gain * (math.tanh(v - y) if tanh else v)
            out.append(y)
        return pdf[keep].assign(y=out), y

    return keyed_scan(df.select(*keep, x), by, order, schema, fold)


def refractory(df: DataFrame, by: Sequence[str], ts: str, gap: float, tie: Sequence[str] = ()) -> DataFrame:
    """Greedy thinning: a row stays if at least ``gap`` after the last kept."""

    def fold(pdf: pd.DataFrame, last: float | None) -> tuple[pd.DataFrame, float | None]:
        keep = []
        for t in pdf[ts].tolist():
            keep.append(last is None or t - last >= gap)
            last = t if keep[-1] else last
        return pdf[np.array(keep, bool)], last

    return keyed_scan(df, by, [ts, *tie], df.schema, fold)
