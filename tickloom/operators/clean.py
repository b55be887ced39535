"""Cleaning, filters and data-quality counts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_reason(df: DataFrame) -> DataFrame:
    """First reason that excludes a swap, '' if none, and clean_keep."""
    bad = lambda c: F.coalesce(F.col(c) <= 0, F.lit(True))
    reason = F.when(F.col("removed"), "removed").when(bad("base"), "base_abs_nonpositive").when(bad("quote"), "quote_abs_nonpositive").when(bad("price"), "price_nonpositive").otherwise("")
    return df.withColumn("clean_reason", reason).withColumn("clean_keep", F.col("clean_reason") == "")


def exclusion_summary(df: DataFrame) -> DataFrame:
    return df.filter("clean_reason != ''").groupBy("clean_reason").agg(F.count(F.lit(1)).alias("n"))


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the largest by ``order``."""
    best = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__r")).select("__r.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    best = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__r")).select("__r.*")


def within_range_of(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows whose value lies between the least and greatest of ``other``."""
    span = other.agg(F.min(other_column).alias("__lo"), F.max(other_column).alias("__hi"))
    return df.join(F.broadcast(span), F.col(column).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")  # one row


def overlaps(lo: Column, hi: Column, frm: Column, to: Column) -> Column:
    return (frm <= hi) & (to >= lo)


def passes(c: Column, cut: float | Column, how: str) -> Column:
    """A null never passes."""
    hit = {"high": c >= cut, "low": c <= cut, "high_abs": F.abs(c) >= cut}[how]
    return F.coalesce(hit, F.lit(False))


def work_queue(wanted: DataFrame, done: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``wanted`` whose keys are not in ``done``, in ``order`` and then
    in that of the keys."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti").orderBy(*order, *keys)


def label_frequency(df: DataFrame, label: str, retry: Sequence[str] = ("rpc", "missing")) -> DataFrame:
    """label, n, share of all rows and retryable (the label holds one of
    ``retry``), in order of label; a null label counts as one, not retryable."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))  # one row
    mends = F.coalesce(F.col(label).rlike("|".join(map(re.escape, retry))), F.lit(False))
    return c.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("total")).alias("share"), mends.alias("retryable")).orderBy(label)


def hash_shard(df: DataFrame, key: str, n: int, i: int) -> DataFrame:
    return df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key; null keys are skipped."""
    known = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return known.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def bad_timestamps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-empty strings that are no UTC timestamps ending in Z."""
    bad = [(F.col(c) != "") & (F.try_to_timestamp(c).isNull() | ~F.endswith(F.col(c), F.lit("Z"))) for c in columns]
    return df.agg(*(F.count_if(F.coalesce(b, F.lit(False))).alias(c) for b, c in zip(bad, columns, strict=True)))


def swap_sanity(df: DataFrame) -> DataFrame:
    zero = (F.col("base") == 0) | (F.col("quote") == 0)
    return df.agg(
        F.count_if(zero).alias("zero_amount"),
        F.count_if(~zero & (F.col("price").isNull() | (F.col("price") <= 0))).alias("bad_price"),
        F.count_if((F.col("base") != 0) & (F.col("direction") == "unknown")).alias("unknown_direction"),
    )


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def sequence_quality(df: DataFrame, by: str, seq: str, ts: str, price: str) -> DataFrame:
    """Sequence gaps, time regressions and bad prices per key."""
    w = Window.partitionBy(by).orderBy(seq)
    d = df.withColumn("__ps", F.lag(seq).over(w)).withColumn("__pt", F.lag(ts).over(w))
    return d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(seq) != F.col("__ps") + 1).alias("gaps"), F.count_if(F.col(ts) < F.col("__pt")).alias("regressions"), F.count_if(~(F.col(price) > 0)).alias("bad_price"))


def content_hash(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Row count and a SHA-256 that do not depend on the order of the rows: the
    sum of a number from each row's MD5, columns in name order; with
    ``digits``, fractions are rounded (−0 counts as 0)."""
    def text(c: str, kind: str) -> Column:
        x = F.round(F.col(c), digits) + 0.0 if digits is not None and kind in ("double", "float") else F.col(c)
        return F.coalesce(x.cast("string"), F.lit("∅"))

    row = F.concat_ws("|", *(text(c, k) for c, k in sorted(df.dtypes)))
    number = F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("decimal(20,0)")
    total = F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").cast("string")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sha2(total.cast("binary"), 256).alias("hash"))


def ordinal_comparison(left: DataFrame, right: DataFrame, order: Sequence[str], tol: float = 0.0) -> DataFrame:
    """Row i of one run with row i of the other: seq, status and the fields
    that differ; rows beyond the shorter run are one-sided."""
    from tickloom.operators.select import with_sequence

    values = [c for c in left.columns if c != order[0]]
    a, b = (with_sequence(x, order[0], list(order[1:])).select("seq", F.struct(*left.columns).alias(n)) for x, n in ((left, "a"), (right, "b")))
    kinds = dict(left.dtypes)

    def same(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        return F.coalesce(F.abs(x - y) <= tol, x.eqNullSafe(y)) if kinds[c] in ("double", "float") else x.eqNullSafe(y)

    fields = F.array_join(F.array_compact(F.array(*(F.when(~same(c), c) for c in values))), "+")
    status = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").otherwise("differs")
    x = a.join(b, "seq", "full_outer").select("seq", status.alias("status"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), fields).alias("fields"))
    return x.filter((F.col("status") != "differs") | (F.col("fields") != ""))


def latest_and_dropped(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n_dropped") -> DataFrame:
    """One row per key, the largest by ``order``, and how many rows it replaced."""
    best, total = F.max_by(F.struct(*df.columns), F.struct(*order)), F.count(F.lit(1)) - 1
    return df.groupBy(*keys).agg(best.alias("kept_row"), total.alias(name)).select("kept_row.*", name)


def shard_of(key: Column, n: int) -> Column:
    """A shard that does not change between runs or engines."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def allowed(column: Column, names: Sequence[str]) -> Column:
    """Membership whatever the case; an empty list allows all."""
    return F.lower(column).isin(*(n.lower() for n in names)) if names else F.lit(True)


def tradable(events: DataFrame, by: Sequence[str], ts: str, amount: str, gas: str, window: int, least_amount: float, least_events: int, least_volume: float, most_gas: float) -> DataFrame:
    """is_tradable: amount, events and volume in the trailing window, gas share."""
    w = Window.partitionBy(*by).orderBy(ts).rangeBetween(-window, 0)
    ok = (F.col(amount) >= least_amount) & (F.count(F.lit(1)).over(w) >= least_events) & (F.sum(amount).over(w) >= least_volume) & (F.col(gas) <= most_gas)
    return events.withColumn("is_tradable", F.coalesce(ok, F.lit(False)))


def chain_audit(log: DataFrame, by: str, kind: str, at: str, numbers: Sequence[str]) -> DataFrame:
    """Violations per intent: steps that are missing, an end without an answer,
    a fill without an acknowledgement, steps out of order, numbers that are not
    finite."""
    has = lambda k: F.max((F.col(kind) == k).cast("int")) == 1
    when = lambda k: F.min(F.when(F.col(kind) == k, F.col(at)))
    bad = [F.max(F.coalesce((F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf"))).cast("int"), F.lit(1))) == 1 for c in numbers]
    order = F.coalesce(when("scheduled") < when("intent"), F.lit(False)) | F.coalesce(when("arrived") < when("scheduled"), F.lit(False)) | F.coalesce(F.least(when("ack"), when("reject")) < when("arrived"), F.lit(False))
    rules = {f"no_{k}": ~has(k) for k in ("intent", "scheduled", "arrived")} | {"no_answer": ~has("ack") & ~has("reject"), "fill_without_ack": has("fill") & ~has("ack"), "out_of_order": order}
    rules |= {f"not_finite_{c}": b for c, b in zip(numbers, bad, strict=True)}
    found = log.groupBy(by).agg(F.array_compact(F.array(*(F.when(b, n) for n, b in rules.items()))).alias("found"))
    return found.select(by, F.explode("found").alias("violation"))


def compare_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], tol: float = 0.0) -> DataFrame:
    """Keyed comparison: one row per differing or one-sided key."""
    values = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*values).alias("a"))
    b = right.select(*keys, F.struct(*values).alias("b"))
    kinds = dict(left.dtypes)

    def same(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        return F.coalesce(F.abs(x - y) <= tol, x.eqNullSafe(y)) if kinds[c] in ("double", "float") else x.eqNullSafe(y)

    status = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").otherwise("differs")
    fine = F.lit(True)
    for c in values:
        fine = fine & same(c)
    return a.join(b, list(keys), "full_outer").filter(F.col("a").isNull() | F.col("b").isNull() | ~fine).select(*keys, status.alias("status"))


def longest_unchanged(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Gaps and islands: the longest run of one value per key."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    island = df.withColumn("__c", change).withColumn("__i", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "__i").agg(F.count(F.lit(1)).alias("__n")).groupBy(*by).agg(F.max("__n").alias("longest_run"), F.count(F.lit(1)).alias("runs"))


def wrong_partition(df: DataFrame, partition: str, day: str) -> DataFrame:
    """Rows, and those whose own day is not the partition's."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(partition).eqNullSafe(F.col(day))).alias("wrong"))


def quote_quality(df: DataFrame, by: str, seq: str, ts: str, snapshot: str) -> DataFrame:
    """Gaps, regressions, bad prices and sizes, crossed quotes, snapshots, and
    whether a book can be rebuilt: a snapshot and no gap."""
    w = Window.partitionBy(by).orderBy(seq)
    d = df.withColumns({"seq_before": F.lag(seq).over(w), "ts_before": F.lag(ts).over(w)})
    gaps, shots = F.count_if(F.col(seq) != F.col("seq_before") + 1), F.count_if(snapshot)
    return d.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), gaps.alias("gaps"), F.count_if(F.col(ts) < F.col("ts_before")).alias("regressions"), F.count_if(~((F.col("bid") > 0) & (F.col("ask") > 0))).alias("bad_price"),
        F.count_if(~((F.col("bid_size") > 0) & (F.col("ask_size") > 0))).alias("bad_size"), F.count_if(F.col("bid") >= F.col("ask")).alias("crossed"), shots.alias("snapshots"), ((shots > 0) & (gaps == 0)).alias("reconstructible"),
    )


def swap_invariants(df: DataFrame, most_bps: float) -> DataFrame:
    """Signed deltas of one sign, directions that the base delta denies, and
    implied against stored prices."""
    gap = F.abs(F.try_divide("implied", "stored") - 1) * 1e4
    return df.agg(F.count_if(F.col("base") * F.col("quote") > 0).alias("same_sign"), F.count_if((F.col("base") != 0) & (F.signum("base") != F.col("told"))).alias("wrong_direction"), F.count_if(gap > most_bps).alias("price_gap"), F.max(gap).alias("max_gap_bps"))


def longest_run(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, ts_us: str) -> DataFrame:
    """The longest run of one value, in rows and in seconds."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    runs = df.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("k"), ((F.max(ts_us) - F.min(ts_us)) / 1e6).alias("sec"))
    return each.groupBy(*by).agg(F.max("k").alias("longest_rows"), F.round(F.max("sec"), 3).alias("longest_seconds"))


def keyed_comparison(left: DataFrame, right: DataFrame, keys: Sequence[str], tol: float = 0.0) -> DataFrame:
    """One row per key that differs, with the fields that do, or that one side
    lacks."""
    values = [c for c in left.columns if c not in keys]
    a, b = left.select(*keys, F.struct(*values).alias("a")), right.select(*keys, F.struct(*values).alias("b"))
    kinds = dict(left.dtypes)

    def same(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        return F.coalesce(F.abs(x - y) <= tol, x.eqNullSafe(y)) if kinds[c] in ("double", "float") else x.eqNullSafe(y)

    fields = F.array_join(F.array_compact(F.array(*(F.when(~same(c), c) for c in values))), "+")
    status = F.when(F.col("b").isNull(), "right_missing").when(F.col("a").isNull(), "left_missing").otherwise("differs")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    x = a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"), F.when(both, fields).alias("fields"))
    return x.filter((F.col("status") != "differs") | (F.col("fields") != ""))
