"""Registered queries over the market views, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import book as B
from tickloom.operators import clean as C
from tickloom.operators import factors as FA
from tickloom.operators import grid as G
from tickloom.operators import joins as J
from tickloom.operators import windows as W
from tickloom.sources.tables import SWAPS_SQL, TICKS_SQL, micros, scan, swaps, ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = ["ts", "tx", "log_index"]
SW = f"WITH {SWAPS_SQL}"
TK = f"WITH {TICKS_SQL}"
ORD = "PARTITION BY pool ORDER BY ts, tx, log_index"
TORD = "PARTITION BY symbol ORDER BY ts_us, event_id"


def _event():
    return Window.partitionBy("pool").orderBy(*KEY)


def _tick():
    return Window.partitionBy("symbol").orderBy("ts_us", "event_id")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: Column | str, name: str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name)


def scaled(c: Column | str, name: str, digits: int = 6) -> Column:
    """``r`` by the double that the scaled value is, as DuckDB rounds; ``r``
    goes by the shortest decimal, so the two part where that ends in a 5."""
    return (F.round((F.col(c) if isinstance(c, str) else c) * 10.0**digits) / 10.0**digits).alias(name)


def n(c: Column, name: str) -> Column:
    return c.cast("long").alias(name)


# -- cleaning and quality ----------------------------------------------------


@query(f"""{SW} SELECT tx, log_index, CASE WHEN removed THEN 'removed' WHEN base <= 0 THEN 'base_abs_nonpositive' WHEN quote <= 0 THEN 'quote_abs_nonpositive' WHEN price <= 0 THEN 'price_nonpositive' ELSE '' END AS clean_reason, NOT removed AND base > 0 AND quote > 0 AND price > 0 AS clean_keep FROM swaps""")
def flt_01_clean_reason(spark, d):
    return C.clean_reason(swaps(spark, d)).select("tx", "log_index", "clean_reason", "clean_keep")


@query(f"{SW} SELECT CASE WHEN removed THEN 'removed' ELSE 'base_abs_nonpositive' END AS clean_reason, count(*) AS n FROM swaps WHERE removed OR base <= 0 GROUP BY 1")
def flt_02_exclusion_summary(spark, d):
    return C.exclusion_summary(C.clean_reason(swaps(spark, d)))


@query(f"{SW} SELECT pool, day, tx, log_index FROM swaps QUALIFY row_number() OVER (PARTITION BY pool, day ORDER BY ts, tx, log_index) = 1")
def flt_04_first_occurrence(spark, d):
    return C.keep_first(swaps(spark, d), ["pool", "day"], KEY).select("pool", "day", "tx", "log_index")


@query(f"{SW} SELECT tx, log_index FROM swaps WHERE ts BETWEEN (SELECT min(o_orderdate) FROM orders WHERE o_orderstatus = 'F') AND (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F')")
def flt_05_block_window(spark, d):
    heads = scan(spark, d, "orders").filter("o_orderstatus = 'F'")
    return C.within_range_of(swaps(spark, d), "ts", heads, "o_orderdate").select("tx", "log_index")


@query(f"{SW} SELECT tx, log_index FROM swaps WHERE quote >= 20000 AND fee <= 0.04")
def flt_07_threshold(spark, d):
    return swaps(spark, d).filter(C.passes(F.col("quote"), 20000, "high") & C.passes(F.col("fee"), 0.04, "low")).select("tx", "log_index")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') ORDER BY o_orderdate, o_orderkey")
def flt_10_work_queue(spark, d):
    done = scan(spark, d, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.work_queue(scan(spark, d, "orders").select("o_orderkey", "o_orderdate"), done, ["o_orderkey"], ["o_orderdate"])


@query(f"{SW} SELECT count(*) FILTER (base = 0 OR quote = 0) AS zero_amount, count(*) FILTER (base <> 0 AND quote <> 0 AND price <= 0) AS bad_price, count(*) FILTER (base <> 0 AND direction = 'unknown') AS unknown_direction FROM swaps")
def qlt_05_swap_sanity(spark, d):
    return C.swap_sanity(swaps(spark, d))


# -- joins -------------------------------------------------------------------


@query(f"{SW} SELECT tx, log_index, o_custkey, CASE WHEN o_orderkey IS NULL THEN 'missing' ELSE o_orderstatus END AS status FROM swaps LEFT JOIN orders ON o_orderkey = tx")
def joi_01_left_dimension(spark, d):
    s, o = swaps(spark, d), scan(spark, d, "orders")
    return s.join(o, F.col("tx") == F.col("o_orderkey"), "left").select("tx", "log_index", "o_custkey", F.when(F.col("o_orderkey").isNull(), "missing").otherwise(F.col("o_orderstatus")).alias("status"))


@query(f"{SW} SELECT tx, log_index, o_totalprice FROM swaps JOIN orders ON o_orderkey = tx")
def joi_02_unique_inner(spark, d):
    o = scan(spark, d, "orders").select(F.col("o_orderkey").alias("tx"), "o_totalprice")
    return J.unique_inner(swaps(spark, d), o, ["tx"]).select("tx", "log_index", "o_totalprice")


_PAIR = f"{TK}, a AS (SELECT symbol, ts_us, event_id FROM ticks WHERE kind <> 'purchase'), b AS (SELECT symbol, ts_us, max(event_id) AS other FROM ticks WHERE kind = 'purchase' GROUP BY 1, 2)"


def _sides(spark, d):
    """Purchases, and all other events."""
    t = ticks(spark, d)
    a = t.filter("kind != 'purchase'").select("symbol", "ts_us", "event_id")
    b = t.filter("kind = 'purchase'").groupBy("symbol", "ts_us").agg(F.max("event_id").alias("other"))
    return a, b


@query(f"{_PAIR} SELECT a.symbol, a.ts_us, a.event_id, b.other, a.ts_us - b.ts_us AS age FROM a ASOF LEFT JOIN b ON a.symbol = b.symbol AND a.ts_us >= b.ts_us")
def joi_04_asof(spark, d):
    a, b = _sides(spark, d)
    return J.asof_join(a, b, "ts_us", ["symbol"], ["other"])


@query(f"{_PAIR} SELECT a.symbol, a.ts_us, a.event_id, b.other, a.ts_us - b.ts_us AS age FROM a ASOF LEFT JOIN b ON a.symbol = b.symbol AND a.ts_us > b.ts_us")
def joi_05_asof_strict(spark, d):
    a, b = _sides(spark, d)
    return J.asof_join(a, b, "ts_us", ["symbol"], ["other"], exact=False)


@query(f"{_PAIR} SELECT a.symbol, a.ts_us, a.event_id, CASE WHEN a.ts_us - b.ts_us <= 86400000000 THEN b.other END AS other, CASE WHEN a.ts_us - b.ts_us <= 86400000000 THEN a.ts_us - b.ts_us END AS age FROM a ASOF LEFT JOIN b ON a.symbol = b.symbol AND a.ts_us >= b.ts_us")
def joi_06_asof_tolerance(spark, d):
    a, b = _sides(spark, d)
    return J.asof_join(a, b, "ts_us", ["symbol"], ["other"], tolerance=86_400_000_000)


@query(f"{_PAIR}, x AS (SELECT a.*, b.other AS o1, a.ts_us - b.ts_us AS g1 FROM a ASOF LEFT JOIN b ON a.symbol = b.symbol AND a.ts_us >= b.ts_us), y AS (SELECT x.*, b.other AS o2, b.ts_us - x.ts_us AS g2 FROM x ASOF LEFT JOIN b ON x.symbol = b.symbol AND x.ts_us <= b.ts_us) SELECT symbol, ts_us, event_id, CASE WHEN g2 IS NOT NULL AND (g1 IS NULL OR g2 <= g1) THEN o2 ELSE o1 END AS other, CASE WHEN g2 IS NOT NULL AND (g1 IS NULL OR g2 <= g1) THEN g2 ELSE g1 END AS age FROM y")
def joi_07_nearest(spark, d):
    a, b = _sides(spark, d)
    return J.nearest_join(a, b, "ts_us", ["symbol"], "other")


@query(f"{_PAIR} SELECT a.symbol, a.ts_us, a.event_id, b.other, b.ts_us - a.ts_us AS age FROM a ASOF LEFT JOIN b ON a.symbol = b.symbol AND a.ts_us <= b.ts_us")
def joi_09_asof_forward(spark, d):
    a, b = _sides(spark, d)
    return J.asof_join(a, b, "ts_us", ["symbol"], ["other"], forward=True)


_DAILY = f"{SW}, daily AS (SELECT pool, date_diff('day', DATE '1970-01-01', day) AS dn, sum(base) AS base, sum(quote) AS quote, sum(quote) / sum(base) AS vwap, count(*) AS n FROM swaps GROUP BY 1, 2)"


def daily(spark, d):
    return swaps(spark, d).groupBy("pool", F.unix_date("day").cast("long").alias("dn")).agg(F.sum("base").alias("base"), F.sum("quote").alias("quote"), S.safe_div(F.sum("quote"), F.sum("base")).alias("vwap"), F.count(F.lit(1)).alias("n"))


@query(f"{_DAILY} SELECT x.pool, x.dn, CAST(lag AS INTEGER) AS lag, x.n AS nx, y.n AS ny FROM daily x CROSS JOIN (VALUES (-1), (0), (1), (7)) v(lag) JOIN daily y ON y.pool = x.pool AND y.dn = x.dn + lag")
def joi_13_lag_grid(spark, d):
    t = daily(spark, d).select("pool", "dn", "n")
    return J.lag_grid(t.withColumnRenamed("n", "nx"), t.withColumnRenamed("n", "ny"), "dn", [-1, 0, 1, 7], ["pool"]).select("pool", "dn", "lag", "nx", "ny")


@query(f"{SW} SELECT tx, log_index FROM swaps WHERE pool IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def joi_16_semi(spark, d):
    ok = scan(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("pool"))
    return swaps(spark, d).join(ok, "pool", "left_semi").select("tx", "log_index")


# -- aggregates --------------------------------------------------------------


@query(f"{SW} SELECT tx, log_index, count(*) OVER (PARTITION BY day) AS same_day, count(*) OVER (PARTITION BY day, pool) AS same_day_pool FROM swaps")
def agg_05_same_block(spark, d):
    w = lambda *k: F.count(F.lit(1)).over(Window.partitionBy(*k))
    return swaps(spark, d).select("tx", "log_index", w("day").alias("same_day"), w("day", "pool").alias("same_day_pool"))


@query(f"{SW}, v AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, pool, sum(quote) AS q FROM swaps WHERE quote > 0 GROUP BY 1, 2), s AS (SELECT month, q / sum(q) OVER (PARTITION BY month) AS sh FROM v) SELECT month, round(max(sh), 9) AS top_share, round(sum(sh * sh), 9) AS hhi FROM s GROUP BY month")
def agg_06_concentration(spark, d):
    v = swaps(spark, d).filter("quote > 0").groupBy(F.to_date(F.date_trunc("month", "ts")).alias("month"), "pool").agg(F.sum("quote").alias("q"))
    s = v.withColumn("sh", S.safe_div(F.col("q"), F.sum("q").over(Window.partitionBy("month"))))
    return s.groupBy("month").agg(r(F.max("sh"), "top_share", 9), r(F.sum(F.col("sh") * F.col("sh")), "hhi", 9))


@query(f"{TK} SELECT symbol, CAST(floor(ts_us / 3600000000) AS BIGINT) AS hour, arg_min(price, (ts_us, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_us, event_id)) AS close, count(*) AS n FROM ticks WHERE price > 0 GROUP BY 1, 2")
def agg_08_ohlc(spark, d):
    t = F.struct("ts_us", "event_id")
    return ticks(spark, d).filter("price > 0").groupBy("symbol", n(F.floor(F.col("ts_us") / 3_600_000_000), "hour")).agg(F.min_by("price", t).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", t).alias("close"), F.count(F.lit(1)).alias("n"))


@query(f"{TK} SELECT CAST(floor(ts_us / 60000000) AS BIGINT) AS minute, count(*) AS trades, round(sum(price), 6) AS amount, round(max(price) / sum(price), 9) AS sweep FROM ticks WHERE price > 0 GROUP BY 1")
def agg_12_sweep_burst(spark, d):
    return ticks(spark, d).filter("price > 0").groupBy(n(F.floor(F.col("ts_us") / 60_000_000), "minute")).agg(F.count(F.lit(1)).alias("trades"), r(F.sum("price"), "amount"), r(S.safe_div(F.max("price"), F.sum("price")), "sweep", 9))


@query(f"{TK} SELECT symbol, CAST(floor(ts_us / 60000000) AS BIGINT) AS minute, arg_max(event_id, (ts_us, event_id)) AS event_id FROM ticks GROUP BY 1, 2")
def agg_14_last_per_minute(spark, d):
    return ticks(spark, d).groupBy("symbol", n(F.floor(F.col("ts_us") / 60_000_000), "minute")).agg(F.max_by("event_id", F.struct("ts_us", "event_id")).alias("event_id"))


@query(f"{SW}, p AS (SELECT pool, sum(quote) AS depth FROM swaps GROUP BY pool), c AS (SELECT quantile_cont(depth, 0.2) AS cut FROM p) SELECT pool, depth <= cut AS vacuum FROM p, c")
def agg_15_low_liquidity(spark, d):
    p = swaps(spark, d).groupBy("pool").agg(F.sum("quote").alias("depth"))
    cut = p.agg(F.percentile("depth", 0.2).alias("cut"))
    return p.join(F.broadcast(cut)).select("pool", (F.col("depth") <= F.col("cut")).alias("vacuum"))  # one row


@query(f"{SW} SELECT pool, direction, count(*) AS n, round(sum(quote), 4) AS volume FROM swaps GROUP BY GROUPING SETS ((), (pool), (direction), (pool, direction))")
def agg_16_grouping_sets(spark, d):
    s = swaps(spark, d)
    return s.groupingSets([[], [s.pool], [s.direction], [s.pool, s.direction]], s.pool, s.direction).agg(F.count(F.lit(1)).alias("n"), r(F.sum("quote"), "volume", 4)).select("pool", "direction", "n", "volume")


@query(f"{SW} SELECT pool, count(*) AS n, round(avg(price), 6) AS mean, round(stddev_pop(price), 6) AS std, round(corr(base, quote), 9) AS corr FROM swaps GROUP BY pool")
def agg_19_moments(spark, d):
    return swaps(spark, d).groupBy("pool").agg(F.count(F.lit(1)).alias("n"), r(F.avg("price"), "mean"), r(F.stddev_pop("price"), "std"), r(F.corr("base", "quote"), "corr", 9))


@query(f"{TK}, c AS (SELECT symbol, kind, count(*) AS n FROM ticks GROUP BY 1, 2) SELECT symbol, arg_max(kind, (n, kind)) AS mode FROM c GROUP BY symbol")
def agg_20_mode(spark, d):
    return ticks(spark, d).groupBy("symbol", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("symbol").agg(F.max_by("kind", F.struct("n", "kind")).alias("mode"))


_REASON = "CASE WHEN direction = 'unknown' THEN 'missing_direction' WHEN removed THEN 'rpc_removed' WHEN fee >= 0.08 THEN 'fee_too_high' ELSE 'ok' END"


@query(f"{SW}, l AS (SELECT {_REASON} AS label FROM swaps) SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share, contains(label, 'rpc') OR contains(label, 'missing') AS retryable FROM l GROUP BY label")
def agg_21_label_frequency(spark, d):
    """Reasons why swaps are left out, in order of name, and which of them a second try may mend."""
    return C.label_frequency(swaps(spark, d).select(F.expr(_REASON).alias("label")), "label").withColumn("share", F.round("share", 9))


@query(f"{TK} SELECT symbol, string_agg(DISTINCT kind, '+' ORDER BY kind) AS kinds FROM ticks GROUP BY symbol")
def agg_22_distinct_join(spark, d):
    return ticks(spark, d).groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds"))


@query(f"{SW} SELECT tx, count(*) AS swaps, count(DISTINCT pool) AS pools, round(sum(quote), 4) AS notional, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT pool) = 1 THEN 'same_pool' WHEN count(DISTINCT direction) > 1 THEN 'round_trip' ELSE 'split' END AS path_class FROM swaps GROUP BY tx")
def agg_25_trade_structure(spark, d):
    m, p, q = F.count(F.lit(1)), F.count_distinct("pool"), F.count_distinct("direction")
    return swaps(spark, d).groupBy("tx").agg(m.alias("swaps"), p.alias("pools"), r(F.sum("quote"), "notional", 4), F.when(m == 1, "single").when(p == 1, "same_pool").when(q > 1, "round_trip").otherwise("split").alias("path_class"))


# -- windows -----------------------------------------------------------------


@query(f"{SW} SELECT tx, log_index, round(ln(price / last_value(price IGNORE NULLS) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 9) AS ret FROM swaps")
def win_02_log_return(spark, d):
    return swaps(spark, d).select("tx", "log_index", r(W.log_return(F.col("price"), _event()), "ret", 9))


@query(f"{SW}, x AS (SELECT *, ln(price / lag(price) OVER ({ORD})) AS ret FROM swaps) SELECT tx, log_index, CASE WHEN count(ret) OVER f >= 15 THEN round(sqrt(sum(ret * ret) OVER f), 9) END AS rv FROM x WINDOW f AS ({ORD} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def win_04_realised_vol(spark, d):
    x = swaps(spark, d).withColumn("ret", W.log_return(F.col("price"), _event()))
    return x.select("tx", "log_index", r(W.realised_vol(F.col("ret"), _event(), 30), "rv", 9))


@query(f"{SW} SELECT tx, log_index, CASE WHEN count(price) OVER f >= 5 AND stddev_pop(price) OVER f > 0 THEN round((price - avg(price) OVER f) / stddev_pop(price) OVER f, 6) END AS z FROM swaps WINDOW f AS ({ORD} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)")
def win_07_zscore(spark, d):
    return swaps(spark, d).select("tx", "log_index", r(W.zscore(F.col("price"), _event(), 30), "z"))


@query(f"{SW} SELECT tx, log_index, CASE WHEN count(price) OVER f >= 5 THEN round((price - quantile_cont(price, 0.5) OVER f) / greatest(quantile_cont(price, 0.75) OVER f - quantile_cont(price, 0.25) OVER f, 1e-9), 6) END AS z FROM swaps WINDOW f AS ({ORD} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def win_09_robust_z(spark, d):
    return swaps(spark, d).select("tx", "log_index", r(W.robust_z(F.col("price"), _event(), 20), "z"))


@query(f"{SW} SELECT tx, log_index, CASE WHEN count(*) OVER f >= 30 THEN round(regr_slope(quote, base) OVER f, 6) END AS beta, CASE WHEN count(*) OVER f >= 30 THEN round(corr(quote, base) OVER f, 6) END AS corr FROM swaps WINDOW f AS ({ORD} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def win_10_rolling_beta(spark, d):
    beta, corr = W.rolling_beta(F.col("quote"), F.col("base"), _event(), 60)
    return swaps(spark, d).select("tx", "log_index", r(beta, "beta"), r(corr, "corr"))


_FLAG = f"{TK}, x AS (SELECT *, price > avg(price) OVER (PARTITION BY symbol) AS up FROM ticks)"


def _flagged(spark, d):
    return ticks(spark, d).withColumn("up", F.col("price") > F.avg("price").over(Window.partitionBy("symbol")))


@query(f"{TK}, x AS (SELECT *, price - lag(price) OVER ({TORD}) AS ch FROM ticks), s AS (SELECT *, sum(coalesce(ch - 0.5, 0)) OVER ({TORD}) AS s FROM x) SELECT event_id, round(s - least(0, min(s) OVER ({TORD})), 6) AS cusum, s - least(0, min(s) OVER ({TORD})) > 50 AS cusum_flag FROM s")
def win_27_cusum(spark, d):
    x = ticks(spark, d).withColumn("ch", F.col("price") - F.lag("price").over(_tick()))
    return W.cusum(x, "ch", ["symbol"], ["ts_us", "event_id"], 0.5, 50.0).select("event_id", r("cusum", "cusum"), "cusum_flag")


@query(f"{TK}, l AS (SELECT event_id, list(price) OVER ({TORD} ROWS UNBOUNDED PRECEDING) AS p FROM ticks) SELECT event_id, round(list_reduce(list_prepend(0.0, p), lambda a, x: 0.82 * a + 0.18 * x), 6) AS y FROM l")
def win_28_linear_filter(spark, d):
    return W.recursive_filter(ticks(spark, d), ["symbol"], ["ts_us", "event_id"], "price").select("event_id", r("y", "y"))


@query(f"{TK}, l AS (SELECT event_id, list(price) OVER ({TORD} ROWS UNBOUNDED PRECEDING) AS p FROM ticks) SELECT event_id, round(list_reduce(list_prepend(0.0, p), lambda a, x: 0.88 * a + 0.12 * (1 - 2 / (exp(2 * (x - a)) + 1))), 6) AS y FROM l")
def win_29_tanh_filter(spark, d):
    return W.recursive_filter(ticks(spark, d), ["symbol"], ["ts_us", "event_id"], "price", 0.88, 0.12, tanh=True).select("event_id", r("y", "y"))


@query(f"""{_FLAG}, i AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER ({TORD}) AS iu, sum(CASE WHEN up THEN 1 ELSE 0 END) OVER ({TORD}) AS id FROM x), n AS (SELECT *, count(*) FILTER (up) OVER (PARTITION BY symbol, iu ORDER BY ts_us, event_id) AS nu, count(*) FILTER (NOT up) OVER (PARTITION BY symbol, id ORDER BY ts_us, event_id) AS nd FROM i),
 e AS (SELECT *, CASE WHEN nu >= 2 THEN true WHEN nd >= 2 THEN false END AS ev FROM n), a AS (SELECT symbol, ts_us, event_id, coalesce(last_value(ev IGNORE NULLS) OVER ({TORD} ROWS UNBOUNDED PRECEDING), false) AS active FROM e) SELECT event_id, active, active AND NOT coalesce(lag(active) OVER ({TORD}), false) AS starts FROM a""")
def win_30_hysteresis(spark, d):
    return W.hysteresis(_flagged(spark, d), "up", ["symbol"], ["ts_us", "event_id"], 2, 2).select("event_id", "active", "starts")


# -- grids -------------------------------------------------------------------


@query(f"{_DAILY}, g AS (SELECT pool, unnest(generate_series(min(dn), max(dn))) AS dn FROM daily GROUP BY pool) SELECT g.pool, g.dn, round(last_value(d.vwap IGNORE NULLS) OVER (PARTITION BY g.pool ORDER BY g.dn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS vwap, CASE WHEN d.vwap IS NULL THEN 'forward_fill' ELSE 'observed' END AS method FROM g LEFT JOIN daily d ON d.pool = g.pool AND d.dn = g.dn")
def grd_02_filled_spine(spark, d):
    bars = daily(spark, d)
    return G.fill_forward(G.spine(bars, ["pool"], "dn", 1), bars, ["pool"], "dn", "vwap").select("pool", "dn", r("vwap", "vwap"), "method")


@query(f"{SW} SELECT tx, log_index FROM swaps QUALIFY (row_number() OVER ({ORD}) - 1) % 7 = 0")
def grd_11_stride(spark, d):
    return G.every_kth(swaps(spark, d), ["pool"], KEY, 7).select("tx", "log_index")


@query(f"{TK} SELECT event_id FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol, floor(ts_us / 86400000000) ORDER BY ts_us, event_id) = 1")
def grd_12_time_bucket(spark, d):
    return G.first_per_bucket(ticks(spark, d), ["symbol"], "ts_us", 86_400_000_000, ["event_id"]).select("event_id")


@query(f"{TK}, l AS (SELECT symbol, ts_us, event_id, list(ts_us) OVER ({TORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ticks) SELECT symbol, ts_us, event_id FROM l WHERE p IS NULL OR len(p) = 0 OR ts_us - list_reduce(p, lambda a, x: CASE WHEN x - a >= 86400000000 THEN x ELSE a END) >= 86400000000")
def grd_13_refractory(spark, d):
    return W.refractory(ticks(spark, d).select("symbol", "ts_us", "event_id"), ["symbol"], "ts_us", 86_400_000_000, ["event_id"])


@query(f"{SW}, x AS (SELECT *, row_number() OVER ({ORD}) - 1 AS i, count(*) OVER (PARTITION BY pool) AS t FROM swaps) SELECT tx, log_index FROM x WHERE i = 0 OR floor(i * 10 / t) <> floor((i - 1) * 10 / t)")
def grd_15_even_sample(spark, d):
    return G.even_sample(swaps(spark, d), ["pool"], KEY, 10).select("tx", "log_index")


# -- labels ------------------------------------------------------------------


@query(f"{SW} SELECT tx, log_index, round(lead(price, 5) OVER ({ORD}) / price - 1, 9) AS ret FROM swaps")
def lbl_01_forward_return(spark, d):
    return swaps(spark, d).select("tx", "log_index", r(S.safe_div(F.lead("price", 5).over(_event()), F.col("price")) - 1, "ret", 9))


@query(f"{SW} SELECT tx, log_index, round(lead(price, 6) OVER w / lead(price, 1) OVER w - 1, 9) AS ret FROM swaps WINDOW w AS ({ORD})")
def lbl_02_entry_gap_return(spark, d):
    return swaps(spark, d).select("tx", "log_index", r(S.safe_div(F.lead("price", 6).over(_event()), F.lead("price", 1).over(_event())) - 1, "ret", 9))


@query(f"{TK} SELECT event_id, max(price) OVER f AS hi, min(price) OVER f AS lo FROM ticks WINDOW f AS (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND 86400000000 FOLLOWING)")
def lbl_05_forward_extremes(spark, d):
    f = W.time_frame(["symbol"], "ts_us", 0, 86_400_000_000)
    return ticks(spark, d).select("event_id", F.max("price").over(f).alias("hi"), F.min("price").over(f).alias("lo"))


# -- factors and controls ----------------------------------------------------

_X = f"{SW}, x AS (SELECT *, lead(price, 1) OVER ({ORD}) / price - 1 AS fwd, ln(quote) AS size FROM swaps)"
_RANKS = "rank() OVER (PARTITION BY pool ORDER BY size) + (count(*) OVER (PARTITION BY pool, size) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY pool ORDER BY fwd) + (count(*) OVER (PARTITION BY pool, fwd) - 1) / 2.0 AS ry"


def _panel(spark, d):
    return swaps(spark, d).withColumn("fwd", S.safe_div(F.lead("price", 1).over(_event()), F.col("price")) - 1).withColumn("size", F.log("quote"))


@query(f"{_X} SELECT pool, count(*) AS n, round(corr(size, fwd), 6) AS pearson FROM x WHERE fwd IS NOT NULL GROUP BY pool HAVING count(*) >= 2")
def fac_01_pearson(spark, d):
    return FA.pearson(_panel(spark, d), "size", "fwd", ["pool"]).filter("n >= 2").select("pool", "n", r("pearson", "pearson"))


@query(f"{_X}, k AS (SELECT pool, {_RANKS} FROM x WHERE fwd IS NOT NULL) SELECT pool, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM k GROUP BY pool HAVING count(*) >= 2")
def fac_02_spearman(spark, d):
    return FA.spearman(_panel(spark, d), "size", "fwd", ["pool"]).filter("n >= 2").select("pool", "n", r("spearman", "spearman"))


@query(f"{SW} SELECT tx, log_index, CAST(floor((row_number() OVER (PARTITION BY pool ORDER BY price, tx, log_index) - 1) * 3 / count(*) OVER (PARTITION BY pool)) AS INTEGER) AS bucket FROM swaps")
def fac_05_equal_buckets(spark, d):
    return FA.equal_buckets(swaps(spark, d), "price", ["pool"], ["tx", "log_index"], 3).select("tx", "log_index", "bucket")


@query(f"{SW}, c AS (SELECT pool, quantile_cont(price, [0.25, 0.5, 0.75]) AS cuts FROM swaps GROUP BY pool) SELECT tx, log_index, CAST(len(list_filter(list_distinct(cuts), lambda q: q < price)) AS INTEGER) AS bucket FROM swaps JOIN c USING (pool)")
def fac_07_qcut(spark, d):
    return FA.cut_buckets(swaps(spark, d), "price", ["pool"], 4).select("tx", "log_index", "bucket")


@query(f"""{_X}, l AS (SELECT tx, log_index, factor, v AS x, fwd AS y FROM x, LATERAL (VALUES ('size', size), ('fee', fee)) t(factor, v) WHERE fwd IS NOT NULL),
 k AS (SELECT *, rank() OVER (PARTITION BY factor ORDER BY x) + (count(*) OVER (PARTITION BY factor, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY factor ORDER BY y) + (count(*) OVER (PARTITION BY factor, y) - 1) / 2.0 AS ry, CAST(floor((row_number() OVER (PARTITION BY factor ORDER BY x, tx, log_index, y) - 1) * 3 / count(*) OVER (PARTITION BY factor)) AS INTEGER) AS b FROM l)
 SELECT factor, 'fwd' AS target, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(avg(y) FILTER (b = 2) - avg(y) FILTER (b = 0), 6) AS spread FROM k GROUP BY factor""")
def fac_09_factor_tests(spark, d):
    t = FA.factor_tests(_panel(spark, d), ["tx", "log_index"], ["size", "fee"], ["fwd"])
    return t.select("factor", "target", "n", r("pearson", "pearson"), r("spearman", "spearman"), r("spread", "spread"))


@query(f"{SW}, u AS (SELECT DISTINCT day FROM swaps), s AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS t FROM u) SELECT CASE WHEN i <= floor(t * 0.6) THEN 'discovery' WHEN i <= floor(t * 0.8) THEN 'validation' ELSE 'forward' END AS split, count(*) AS n FROM swaps JOIN s USING (day) GROUP BY 1")
def fac_11_split(spark, d):
    return FA.chronological_split(swaps(spark, d), "day").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("WITH k AS (SELECT lang, toxic, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rk FROM documents JOIN labels USING (doc_id)), a AS (SELECT lang, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS q, sum(rk) FILTER (toxic = 1) AS s FROM k GROUP BY lang) SELECT lang, p AS positives, q AS negatives, CASE WHEN p * q > 0 AND p + q >= 50 THEN round((s - p * (p + 1) / 2.0) / (p * q), 9) END AS auc, CASE WHEN p * q > 0 AND p + q >= 50 THEN round(greatest((s - p * (p + 1) / 2.0) / (p * q), 1 - (s - p * (p + 1) / 2.0) / (p * q)), 9) END AS best FROM a")
def fac_26_auc(spark, d):
    x = scan(spark, d, "documents").select("doc_id", "lang", "n_chars").join(scan(spark, d, "labels"), "doc_id")
    auc = F.when(F.col("positives") + F.col("negatives") >= 50, F.col("auc"))
    return FA.auc(x, "n_chars", "toxic", ["lang"]).select("lang", "positives", "negatives", r(auc, "auc", 9), r(F.greatest(auc, 1 - auc), "best", 9))


@query(f"{_X}, k AS (SELECT pool, fwd, row_number() OVER (PARTITION BY pool ORDER BY fwd) AS i, count(*) OVER (PARTITION BY pool) AS n, ceil(count(*) OVER (PARTITION BY pool) * 0.1) AS t FROM x WHERE fwd IS NOT NULL) SELECT pool, round(avg(fwd) FILTER (i <= t), 9) AS tail_mean, round(avg(fwd) FILTER (n - i >= t), 9) AS trimmed_mean FROM k GROUP BY pool")
def fac_31_tail(spark, d):
    """The mean of the worst tenth, and of all but the best tenth."""
    x = _panel(spark, d)
    trimmed = FA.trimmed_mean(x, "fwd", ["pool"], 0.1)
    return FA.expected_shortfall(x, "fwd", ["pool"], 0.1).join(trimmed, "pool").select("pool", r("tail_mean", "tail_mean", 9), r("trimmed_mean", "trimmed_mean", 9))


@query(f"{SW} SELECT pool, round(greatest(mad(price), 1e-9), 6) AS mad FROM swaps GROUP BY pool")
def fac_32_mad(spark, d):
    return FA.mad(swaps(spark, d), "price", ["pool"]).select("pool", r("mad", "mad"))


@query()
def ctl_04_shuffle(spark, d):
    return FA.shuffle_within(swaps(spark, d), ["pool", "day"], ["tx", "log_index"], "price", 7).select("tx", "log_index", "price", "shuffled")


@query()
def ctl_08_bootstrap(spark, d):
    return FA.bootstrap_mean(_panel(spark, d), "fwd", "tx", ["pool"], 50, 11)


@query(f"{_X}, g AS (SELECT pool, day, sum(fwd) AS s, count(fwd) AS n FROM x GROUP BY 1, 2), t AS (SELECT pool, (sum(s) OVER w - coalesce(s, 0)) / nullif(sum(n) OVER w - n, 0) AS m FROM g WINDOW w AS (PARTITION BY pool)) SELECT pool, round(min(m), 9) AS min_mean FROM t GROUP BY pool")
def ctl_10_leave_one_out(spark, d):
    return FA.leave_one_out_min(_panel(spark, d), "fwd", "day", ["pool"]).select("pool", r("min_mean", "min_mean", 9))


# -- portfolio, order, shape -------------------------------------------------


@query(f"{SW}, v AS (SELECT pool, sum(quote) AS total, min(quote) AS worst FROM swaps GROUP BY pool), m AS (SELECT *, max(worst) OVER (ORDER BY total DESC, pool ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM v) SELECT pool FROM m WHERE best IS NULL OR worst > best")
def pf_12_pareto(spark, d):
    v = swaps(spark, d).groupBy("pool").agg(F.sum("quote").alias("total"), F.min("quote").alias("worst"))
    w = Window.orderBy(F.desc("total"), "pool").rowsBetween(Window.unboundedPreceding, -1)  # one row per variant
    return v.withColumn("best", F.max("worst").over(w)).filter("best is null or worst > best").select("pool")


@query(f"{SW} SELECT pool, tx, log_index, quote, CAST(row_number() OVER w AS INTEGER) AS place FROM swaps WINDOW w AS (PARTITION BY pool ORDER BY quote DESC, tx, log_index) QUALIFY row_number() OVER w <= 3")
def srt_03_top_k_per_group(spark, d):
    w = Window.partitionBy("pool").orderBy(F.desc("quote"), "tx", "log_index")
    return swaps(spark, d).withColumn("place", F.row_number().over(w)).filter("place <= 3").select("pool", "tx", "log_index", "quote", "place")


@query(f"{SW} SELECT pool, count(*) FILTER (direction = 'buy_base') AS buy_base, count(*) FILTER (direction = 'sell_base') AS sell_base, count(*) FILTER (direction = 'unknown') AS unknown FROM swaps GROUP BY pool")
def srt_08_pivot(spark, d):
    p = swaps(spark, d).groupBy("pool").pivot("direction", ["buy_base", "sell_base", "unknown"]).agg(F.count(F.lit(1)))
    return p.fillna(0)


@query(f"{SW} SELECT tx, log_index, name, value FROM swaps UNPIVOT (value FOR name IN (base, quote, fee))")
def srt_09_unpivot(spark, d):
    return swaps(spark, d).unpivot(["tx", "log_index"], ["base", "quote", "fee"], "name", "value")


# -- book --------------------------------------------------------------------

@query(f"{TK}, x AS (SELECT *, coalesce(lag(price) OVER ({TORD}), 0) AS p FROM ticks) SELECT event_id, CASE WHEN price = p THEN 'no_op' WHEN p = 0 THEN 'create' WHEN price = 0 THEN 'remove' WHEN price > p THEN 'replenish' ELSE 'decrease' END AS update_class FROM x")
def bk_04_update_class(spark, d):
    return B.update_class(ticks(spark, d), ["symbol"], ["ts_us", "event_id"], "price").select("event_id", "update_class")


# -- flagship ----------------------------------------------------------------


@query(f"""{_DAILY}, c AS (SELECT pool, dn, vwap, ln(vwap / lag(vwap) OVER w) AS ret, lead(vwap, 2) OVER w / lead(vwap, 1) OVER w - 1 AS fwd FROM daily WINDOW w AS (PARTITION BY pool ORDER BY dn))
 SELECT pool, dn, round(vwap, 6) AS vwap, round(ret, 9) AS ret, CASE WHEN count(ret) OVER f >= 5 THEN round(sqrt(sum(ret * ret) OVER f), 9) END AS rv, round(fwd, 9) AS fwd FROM c WINDOW f AS (PARTITION BY pool ORDER BY dn ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def market_table(spark, d):
    """Cleaned swaps → bars → returns, volatility and forward label."""
    w = Window.partitionBy("pool").orderBy("dn")
    x = daily(spark, d).withColumn("ret", W.log_return(F.col("vwap"), w))
    fwd = S.safe_div(F.lead("vwap", 2).over(w), F.lead("vwap", 1).over(w)) - 1
    return x.select("pool", "dn", r("vwap", "vwap"), r("ret", "ret", 9), r(W.realised_vol(F.col("ret"), w, 24, 5), "rv", 9), r(fwd, "fwd", 9))
