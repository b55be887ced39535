"""Scalar rules used everywhere: what is missing or not finite is null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_div(a: Column, b: Column) -> Column:
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def quotient(a: Column, b: Column) -> Column:
    """a / b as the SQL has it: infinite or undefined, instead of an error,
    where b is 0."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(F.isnan(a) | (a == 0), float("nan")).otherwise(F.signum(a) * float("inf"))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def natural_log(c: Column) -> Column:
    """ln as the SQL has it: -inf of 0 and undefined, instead of null, below."""
    return F.when(c == 0, float("-inf")).when(c < 0, float("nan")).otherwise(F.log(c))


def clean_zero(c: Column, eps: float = 1e-12) -> Column:
    return F.when(F.abs(c) < eps, 0.0).otherwise(c)


def log_ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.when((a > 0) & (b > 0), F.log(a / b) * scale)


def epoch_micros(n: Column) -> Column:
    """Seconds, milli-, micro- or nanoseconds, told by magnitude → micros, in
    whole numbers throughout."""
    n = n.cast("long")
    whole = (n - F.pmod(n, F.lit(1000))) / F.lit(1000).cast("decimal(20,0)")
    return F.when(n >= 10**17, whole.cast("long")).when(n >= 10**14, n).when(n >= 10**11, n * 1000).otherwise(n * 1_000_000).cast("long")


def row_mean(*cols: Column) -> Column:
    """Mean of the finite arguments; null when there is none."""
    kept = F.filter(F.array(*map(finite, cols)), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def side_sign(direction: Column) -> Column:
    return F.when(direction == "buy_base", 1).when(direction == "sell_base", -1).otherwise(0)


def three_way(c: Column, low: float, high: float, names: Sequence[str] = ("low", "mid", "high")) -> Column:
    return F.when(c < low, names[0]).when(c < high, names[1]).when(c.isNotNull(), names[2])


def signed_bucket(c: Column, weak: float, strong: float) -> Column:
    return F.when(c <= -strong, "strong_negative").when(c <= -weak, "weak_negative").when(c < weak, "neutral").when(c < strong, "weak_positive").when(c.isNotNull(), "strong_positive")


def unit_hash(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash, the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") / float(1 << 53)


def sqrt_price(s: Column, d0: Column, d1: Column, invert: Column) -> Column:
    p = F.pow(s.cast("double") / 2.0**96, 2) * F.pow(F.lit(10.0), d0 - d1)
    return F.when(invert, safe_div(F.lit(1.0), p)).otherwise(finite(p))


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, within 7.5e-8, as one expression."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def close_probability(spot: Column, strike: Column, vol: Column, years: Column) -> Column:
    d = F.log(spot / strike) / (vol * F.sqrt(years))
    return F.when((vol > 0) & (years > 0) & (spot > 0) & (strike > 0), normal_cdf(d)).when(spot > strike, 1.0).otherwise(0.0)


def annual_from_bps(bps: Column, hours: float) -> Column:
    return bps / 1e4 * (24 * 365 / hours) ** 0.5 * 100


def money(text: Column) -> Column:
    """'$1.5k' → 1500.0; null where it is no amount."""
    num = F.regexp_extract(text, r"\$?([0-9]+(?:\.[0-9]+)?)", 1)
    unit = F.lower(F.regexp_extract(text, r"[0-9]([kKmM])\b", 1))
    return F.when(num != "", num.cast("double") * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0))


def option_symbol(s: Column) -> Column:
    """'BTC-27JUN25-60000-C' → struct(underlying, expiry, strike, is_call)."""
    pattern = r"^([A-Z]+)-(\d{1,2})([A-Z]{3})(\d{2})-(\d+(?:\.\d+)?)-([CP])$"
    part = lambda i: F.regexp_extract(s, pattern, i)
    months = F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC")
    month = (F.instr(months, part(3)) + 2) / 3
    date = F.make_date(2000 + part(4).cast("int"), month.cast("int"), part(2).cast("int"))
    return F.when(s.rlike(pattern), F.struct(part(1).alias("underlying"), date.alias("expiry"), part(5).cast("double").alias("strike"), (part(6) == "C").alias("is_call")))


def repair_quote(bid: Column, ask: Column, mark: Column) -> tuple[Column, Column, Column]:
    """Crossed sides change places; the mark is held between them."""
    low, high = F.least(bid, ask), F.greatest(bid, ask)
    return low, high, F.greatest(F.least(mark, high), low)


def rescale_fractions(df: DataFrame, column: str, below: float = 2.0, by: float = 100.0) -> DataFrame:
    """Times ``by`` where the median positive value says that fractions were
    written.  Values are counted before the median, which reads one row each."""
    counts = df.filter(F.col(column) > 0).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    median = counts.agg(F.percentile("v", 0.5, F.col("n")).alias("m"))
    return df.join(F.broadcast(median)).withColumn(column, F.when(F.col("m") < below, F.col(column) * by).otherwise(F.col(column))).drop("m")  # one row


def bps_from_annual(pct: Column, hours: float) -> Column:
    return pct / 100 / (24 * 365 / hours) ** 0.5 * 1e4


def side_return_bps(side: Column, entry: Column, exit_: Column) -> Column:
    return side * (safe_div(exit_, entry) - 1) * 1e4


def trade_cost_bps(maker: Column, maker_bps: float, taker_bps: float, crossing: Column) -> Column:
    return F.when(maker, maker_bps).otherwise(taker_bps + crossing)


def sign_label(c: Column) -> Column:
    return F.when(c > 0, "positive").when(c < 0, "negative").when(c == 0, "zero")


def wall_side(c: Column, least: float) -> Column:
    return F.when(c > least, "bid_wall").when(c < -least, "ask_wall").when(c.isNotNull(), "balanced")
