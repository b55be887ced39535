"""Volatility surfaces of option snapshots, regime factors and their tests."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import finite, safe_div
from tickloom.operators.factors import spearman, with_ranks

YEAR_HOURS = 8760.0


def _known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def surface(options: DataFrame, by: Sequence[str], at: str, tie: str) -> DataFrame:
    """A row for each ``by`` and instant: front and next expiry, implied vols at
    the money and at a delta of a quarter, skew, term slope, spread and coverage.

    ``options`` has expiry and ``at`` (timestamps), is_call, mark_iv, delta,
    bid_price, ask_price, mark_price.  Only instruments that have not expired
    and have a positive implied vol take part.  The vol of a delta is that of the
    instrument nearest to it, ties to the smaller ``tie``; at the money is the
    mean of the nearest call and put to a half.  First a row an expiry, combined
    before the shuffle, then the two nearest expiries of an instant.
    """
    hours = (F.col("expiry").cast("double") - F.col(at).cast("double")) / 3600
    live = options.withColumn("dte_hours", hours).filter((F.col("dte_hours") > 0) & _known("mark_iv") & (F.col("mark_iv") > 0))
    use = lambda target: F.when(F.col("is_call") == F.lit(target > 0), F.when(_known("delta"), F.struct(F.abs(F.col("delta") - target), tie)))
    nearest = lambda target: F.min_by("mark_iv", use(target))
    quoted = ((F.coalesce("bid_price", F.lit(0.0)) > 0) | (F.coalesce("ask_price", F.lit(0.0)) > 0)) & (F.coalesce("mark_price", F.lit(0.0)) > 0)
    each = live.groupBy(*by, at, "expiry").agg(
        F.max("dte_hours").alias("dte"), nearest(0.5).alias("call_50"), nearest(-0.5).alias("put_50"), nearest(0.25).alias("call_25"), nearest(-0.25).alias("put_25"),
        F.median(F.greatest(F.col("ask_price") - F.col("bid_price"), F.when(F.col("ask_price").isNotNull() & F.col("bid_price").isNotNull(), 0.0))).alias("spread"),
        F.count_if(quoted).alias("quoted"), F.count(F.lit(1)).alias("instruments"),
    )
    atm = F.coalesce((F.col("call_50") + F.col("put_50")) / 2, "call_50", "put_50")
    each = each.withColumn("atm", atm)
    both = each.groupBy(*by, at).agg(F.slice(F.sort_array(F.collect_list(F.struct("expiry", "dte", "atm", "call_25", "put_25", "spread", "quoted", "instruments"))), 1, 2).alias("e"))  # a row an expiry
    front, after = F.get("e", F.lit(0)), F.get("e", F.lit(1))
    return both.select(
        *by, at, front["expiry"].alias("front_expiry"), front["dte"].alias("front_dte_hours"), after["expiry"].alias("next_expiry"), after["dte"].alias("next_dte_hours"),
        front["atm"].alias("atm_iv"), front["put_25"].alias("put_25d_iv"), front["call_25"].alias("call_25d_iv"), (front["put_25"] - front["call_25"]).alias("skew_25d"), (after["atm"] - front["atm"]).alias("term_slope"),
        front["spread"].alias("spread_median"), (front["spread"] * 10_000).alias("spread_median_bps"), (front["quoted"] / front["instruments"]).alias("quote_coverage"), front["instruments"].alias("front_instruments"),
    )


def rank_percents(df: DataFrame, columns: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """``df`` and, under each new name, 100 × average rank / known values of a
    column per key; null where the key has fewer than two different values.
    Ranks are those of slices of values, so no task sorts a whole key."""
    out = df
    for x, name in columns.items():
        some = df.filter(_known(x)).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))  # a row a value
        w = Window.partitionBy(*by)
        before = F.coalesce(F.sum("n").over(w.orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        pct = F.when(F.count(F.lit(1)).over(w) > 1, (before + (F.col("n") + 1) / 2) / F.sum("n").over(w) * 100)
        ranks = some.select(*(F.col(c).alias(f"of_{c}") for c in by), F.col(x).alias("of_value"), pct.alias(name))
        same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by]
        out = out.join(ranks, [*same, F.col(x) == F.col("of_value")], "left").drop("of_value", *(f"of_{c}" for c in by))
    return out


def regime_factors(surfaces: DataFrame, index: DataFrame, by: Sequence[str], at: str, horizon_hours: float = 12.0, lag: int = 12) -> DataFrame:
    """Surfaces with the index's realised vols (rv_1h, rv_6h, rv_12h, in bps of
    the window) and range_6h, and what the two give: richness, ratio and gap of
    implied against realised, stress and sizes, changes over ``lag`` rows and
    rank percents per key."""
    annual = lambda c, hours: F.col(c) * math.sqrt(YEAR_HOURS / hours) / 100
    w = Window.partitionBy(*by).orderBy(at)
    d = surfaces.join(index.select(*by, at, "rv_1h", "rv_6h", "rv_12h", "range_6h"), [*by, at], "left")
    d = d.withColumns({f"rv_{h}h_ann_pct": annual(f"rv_{h}h", float(h)) for h in (1, 6, 12)})
    d = d.withColumns({
        "iv_richness_12h": F.col("atm_iv") - F.col("rv_12h_ann_pct"), "iv_rv_ratio_12h": finite(safe_div(F.col("atm_iv"), F.col("rv_12h_ann_pct"))),
        "implied_move_bps": F.col("atm_iv") * math.sqrt(horizon_hours / YEAR_HOURS) * 100, "term_stress": -F.col("term_slope"), "abs_term_slope": F.abs("term_slope"), "abs_skew_25d": F.abs("skew_25d"),
        "compression_rel_to_rv_6h": finite(safe_div(F.col("range_6h"), F.col("rv_6h"))),
    }).withColumn("vol_premium_gap_bps", F.col("implied_move_bps") - F.col("rv_12h"))
    d = d.withColumns({f"{n}_change": F.col(c) - F.lag(c, lag).over(w) for n, c in (("atm_iv", "atm_iv"), ("skew_25d", "skew_25d"), ("term_slope", "term_slope"), ("iv_richness", "iv_richness_12h"))})
    return rank_percents(d, {"atm_iv": "atm_iv_rank_pct", "skew_25d": "skew_25d_rank_pct", "term_slope": "term_slope_rank_pct", "range_6h": "range_rank_pct"}, by)


def spearman_table(df: DataFrame, factors: Sequence[str], targets: Sequence[str], by: Sequence[str], least: int = 20) -> DataFrame:
    """A row for each key and factor with ``least`` known values, three of them
    different: n, median, the 10 and 90 per cent points, and the rank
    correlation with each target, null below ``least`` pairs or with a constant
    target.  Quantiles come from places in slices of values."""
    cell = [*by, "factor"]
    long = df.unpivot([*by, *targets], [*factors], "factor", "x")
    long = long.filter(_known("x"))
    placed = with_ranks(long.select(*cell, "x"), "x", cell, None, place="place", total="n")
    spot = lambda q: (F.col("n") - 1) * q

    def point(q: float) -> Column:  # linear between the two values around the spot
        lo = F.max(F.when(F.col("place") == F.floor(spot(q)), F.col("x")))
        hi = F.max(F.when(F.col("place") == F.ceil(spot(q)), F.col("x")))
        return lo + (hi - lo) * F.max(spot(q) - F.floor(spot(q)))

    kinds = placed.groupBy(*cell, "x").agg(F.count(F.lit(1)).alias("same")).groupBy(*cell).agg(F.count(F.lit(1)).alias("kinds"))
    some = placed.groupBy(*cell).agg(F.max("n").alias("n"), point(0.5).alias("factor_median"), point(0.1).alias("factor_p10"), point(0.9).alias("factor_p90"))
    some = some.join(kinds, cell).filter((F.col("n") >= least) & (F.col("kinds") >= 3)).drop("kinds")
    pairs = long.unpivot([*cell, "x"], [*targets], "target", "y").filter(_known("y"))
    rho = spearman(pairs, "x", "y", [*cell, "target"])
    wide = rho.groupBy(*cell).pivot("target", [*targets]).agg(F.max(F.when(F.col("n") >= least, F.col("spearman"))))
    return some.join(wide.withColumnsRenamed({t: f"rho_{t}" for t in targets}), cell, "left")
