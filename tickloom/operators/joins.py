"""The as-of family and other joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, ts: str, by: Sequence[str], values: Sequence[str], exact: bool = True, tolerance: int | None = None, forward: bool = False, tie: str | None = None) -> DataFrame:
    """``left`` + the values of the last (or first, ``forward``) row of
    ``right`` at or before (after) its time, and the age in the unit of ``ts``.

    Both sides are put in one order and the match is a running last value, so
    there is one shuffle on ``by`` and no range join.  ``exact=False`` takes
    only strictly earlier (later) rows.  Equal times on the right resolve to
    the larger ``tie``.  ``ts`` is a number.
    """
    side = [F.lit(None).cast(dict(right.dtypes)[v]).alias(f"__v_{v}") for v in values]
    own = [c for c in left.columns if c not in by and c != ts]
    none = [F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in own]
    first_right = exact != forward
    lt = F.lit(1 if first_right else 0)
    tie_col = lambda is_right: (F.col(tie).cast("double") if tie and is_right else F.lit(None).cast("double")).alias("__tie")
    a = left.select(*by, ts, *own, F.lit(None).cast(dict(right.dtypes)[ts]).alias("__rt"), *side, lt.alias("__o"), F.lit(True).alias("__left"), tie_col(False))
    b = right.select(*by, ts, *none, F.col(ts).alias("__rt"), *(F.col(v).alias(f"__v_{v}") for v in values), F.lit(0 if first_right else 1).alias("__o"), F.lit(False).alias("__left"), tie_col(True))
    # forward runs the order backwards: a frame to the end of the key would be
    # evaluated anew for each row
    way = F.desc if forward else F.asc
    w = Window.partitionBy(*by).orderBy(way(ts), way("__o"), "__tie")
    pack = F.when(~F.col("__left"), F.struct("__rt", *(f"__v_{v}" for v in values)))
    pick = F.last(pack, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    m = a.unionByName(b).withColumn("__m", pick).filter("__left")
    age = F.abs(F.col(ts) - F.col("__m.__rt"))
    ok = F.lit(True) if tolerance is None else age <= tolerance
    return m.select(*left.columns, *(F.when(ok, F.col(f"__m.__v_{v}")).alias(v) for v in values), F.when(ok, age).alias("age"))


def nearest_join(left: DataFrame, right: DataFrame, ts: str, by: Sequence[str], value: str, tolerance: int | None = None) -> DataFrame:
    """The row nearest in time; of two equally near the later one."""
    back = asof_join(left, right, ts, by, [value], tolerance=tolerance).withColumnsRenamed({value: "__b", "age": "__ba"})
    both = asof_join(back, right, ts, by, [value], tolerance=tolerance, forward=True)
    later = F.col("age").isNotNull() & (F.col("__ba").isNull() | (F.col("age") <= F.col("__ba")))
    return both.select(*left.columns, F.when(later, F.col(value)).otherwise(F.col("__b")).alias(value), F.when(later, F.col("age")).otherwise(F.col("__ba")).alias("age"))


def unique_inner(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails when a key repeats on the right."""
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*[c for c in right.columns if c not in keys])).alias("__r"))
    checked = one.withColumn("__ok", F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("key repeats")).cast("boolean")))
    return left.join(checked.filter("__ok"), list(keys)).select(*left.columns, "__r.*")


def lag_grid(x: DataFrame, y: DataFrame, t: str, lags: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Pairs (x at t, y at t + lag) for every lag of a short list."""
    shifted = x.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("__t", F.col(t) + F.col("lag"))
    return shifted.join(y.withColumnRenamed(t, "__t"), [*by, "__t"]).drop("__t")
