"""Registered queries: further joins, grids, labels, factor, control,
portfolio, option and prediction-market tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import evaluate as EV
from tickloom.operators import factors as FA
from tickloom.operators import grid as G
from tickloom.operators import joins as J
from tickloom.operators import wider as X
from tickloom.operators import windows as W
from tickloom.plans.market import _DAILY, _X, ORD, SW, TK, TORD, _event, _panel, _tick, daily, query, r
from tickloom.plans.signals import _DW, SIGN, _days, _side
from tickloom.sources.tables import swaps, ticks

ID = ("tx", "log_index")
HOUR = 3_600_000_000
DELAYS = (60_000_000, HOUR, 24 * HOUR)
KINDS = ("click", "error", "purchase", "signup", "view")
_GRID = f"{_DAILY}, e AS (SELECT pool, min(dn) AS lo, max(dn) AS hi FROM daily GROUP BY 1), g AS (SELECT pool, unnest(generate_series(lo, hi)) AS dn FROM e)"
_HOURS = f"{TK}, h AS (SELECT symbol, ts_us // {HOUR} AS hour, kind, avg(price) AS price, count(*) AS n FROM ticks GROUP BY 1, 2, 3)"


def _hours(spark, d):
    return ticks(spark, d).groupBy("symbol", F.expr(f"ts_us div {HOUR}").alias("hour"), "kind").agg(F.avg("price").alias("price"), F.count(F.lit(1)).alias("n"))


def _grid(spark, d):
    bars = daily(spark, d)
    return G.spine(bars, ["pool"], "dn", 1), bars


# -- windows -----------------------------------------------------------------


@query(f"{_GRID}, x AS (SELECT g.pool, g.dn, coalesce(ln(vwap / lag(vwap) OVER w), 0) AS ret FROM g LEFT JOIN daily USING (pool, dn) WINDOW w AS (PARTITION BY g.pool ORDER BY g.dn)) SELECT pool, dn, round(sqrt(avg(ret * ret) OVER ({_DW} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)), 7) AS vol_6, round(sqrt(avg(ret * ret) OVER ({_DW} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)), 7) AS vol_30 FROM x")
def win_05_grid_volatility(spark, d):
    spine, bars = _grid(spark, d)
    x = spine.join(bars, ["pool", "dn"], "left").withColumn("ret", F.coalesce(F.log(F.col("vwap") / F.lag("vwap").over(_days())), F.lit(0.0)))
    vol = lambda k: F.sqrt(F.avg(F.col("ret") * F.col("ret")).over(W.rows(_days(), -k, -1)))
    return x.select("pool", "dn", r(vol(6), "vol_6", 7), r(vol(30), "vol_30", 7))


_OUT = f"{TK}, o AS (SELECT event_id, symbol, lead(price) OVER w - price AS y, lead(ts_us) OVER w + {HOUR} AS at FROM ticks WINDOW w AS ({TORD}))"


def _outcomes(spark, d):
    t = ticks(spark, d)
    o = t.select("event_id", "symbol", (F.lead("price").over(_tick()) - F.col("price")).alias("y"), (F.lead("ts_us").over(_tick()) + HOUR).alias("at"))
    return t.select("event_id", "symbol", F.col("ts_us").alias("at")), o.filter("y is not null")


@query(f"{_OUT}, j AS (SELECT t.event_id, o.y, row_number() OVER (PARTITION BY t.event_id ORDER BY o.at DESC, o.event_id DESC) AS k FROM ticks t JOIN o ON o.symbol = t.symbol AND o.at <= t.ts_us AND o.y IS NOT NULL), a AS (SELECT event_id, count(*) AS n, sum(greatest(y, 0)) AS up, sum(least(y, 0)) AS down, avg(y) AS mean, min(y) AS worst FROM j WHERE k <= 20 GROUP BY 1) SELECT t.event_id, coalesce(n, 0) AS n, round(up, 6) AS up, round(down, 6) AS down, round(mean, 9) AS mean, round(worst, 6) AS worst FROM ticks t LEFT JOIN a USING (event_id)")
def win_25_prior_outcomes(spark, d):
    entries, o = _outcomes(spark, d)
    s = X.prior_outcomes(entries, o, "at", ["symbol"], "y", ["event_id"], 20)
    return s.select("event_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), r("up", "up"), r("down", "down"), r("mean", "mean", 9), r("worst", "worst"))


@query(f"{_OUT}, a AS (SELECT t.event_id, count(*) AS n, avg(y) AS mean, avg(CASE WHEN y > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM ticks t JOIN o ON o.symbol = t.symbol AND o.at <= t.ts_us AND o.y IS NOT NULL GROUP BY 1) SELECT t.event_id, coalesce(n, 0) AS n, round(mean, 9) AS mean, round(win_rate, 9) AS win_rate FROM ticks t LEFT JOIN a USING (event_id)")
def win_26_prior_wallet(spark, d):
    entries, o = _outcomes(spark, d)
    s = X.prior_outcomes(entries, o, "at", ["symbol"], "y", ["event_id"], None)
    return s.select("event_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), r("mean", "mean", 9), r("win_rate", "win_rate", 9))


# -- joins -------------------------------------------------------------------


@query(f"{_HOURS}, a AS (SELECT symbol, hour, price, n FROM h WHERE kind = 'click'), b AS (SELECT symbol, hour, price, n FROM h WHERE kind = 'view'), c AS (SELECT symbol, hour, price, n FROM h WHERE kind = 'purchase') SELECT symbol, hour, round(coalesce(a.price, b.price, c.price), 6) AS price, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(c.n, 0) AS n_c FROM a FULL JOIN b USING (symbol, hour) FULL JOIN c USING (symbol, hour)")
def joi_03_outer_state(spark, d):
    h = _hours(spark, d)
    a, b, c = (h.filter(F.col("kind") == k).select("symbol", "hour", F.col("price").alias(f"p_{s}"), F.col("n").alias(f"n_{s}")) for k, s in (("click", "a"), ("view", "b"), ("purchase", "c")))
    u = a.join(b, ["symbol", "hour"], "full_outer").join(c, ["symbol", "hour"], "full_outer")
    return u.select("symbol", "hour", r(F.coalesce("p_a", "p_b", "p_c"), "price"), *(F.coalesce(k, F.lit(0)).alias(k) for k in ("n_a", "n_b", "n_c")))


@query(f"{_DAILY} SELECT s.tx, s.log_index, f.n AS past_n, round(f.quote, 2) AS past_quote FROM swaps s LEFT JOIN daily f ON f.pool = s.pool AND f.dn = date_diff('day', DATE '1970-01-01', s.day) - 1")
def joi_11_lagged_equi(spark, d):
    flow = daily(spark, d).select("pool", (F.col("dn") + 1).alias("dn"), F.col("n").alias("past_n"), F.col("quote").alias("past_quote"))
    return swaps(spark, d).withColumn("dn", F.unix_date("day").cast("long")).join(flow, ["pool", "dn"], "left").select(*ID, "past_n", r("past_quote", "past_quote", 2))


@query(f"{_HOURS} SELECT a.symbol, a.hour, a.kind, b.kind AS other, round(a.price / b.price - 1, 9) AS basis, round(a.n / b.n, 9) AS activity_ratio FROM h a JOIN h b ON a.symbol = b.symbol AND a.hour = b.hour AND a.kind <> b.kind")
def joi_12_cross_venue(spark, d):
    h = _hours(spark, d)
    b = h.select("symbol", "hour", F.col("kind").alias("other"), F.col("price").alias("p2"), F.col("n").alias("n2"))
    return h.join(b, ["symbol", "hour"]).filter("kind <> other").select("symbol", "hour", "kind", "other", r(S.quotient(F.col("price"), F.col("p2")) - 1, "basis", 9), r(F.col("n") / F.col("n2"), "activity_ratio", 9))


@query(f"{_DAILY} SELECT f.pool, f.dn, round(f.vwap, 6) AS vwap, round(l.vwap, 6) AS leader_vwap FROM daily f JOIN daily l ON l.dn = f.dn AND l.pool = 0 WHERE f.pool <> 0")
def joi_14_leader_follower(spark, d):
    t = daily(spark, d).select("pool", "dn", r("vwap", "vwap"))
    return t.filter("pool <> 0").join(t.filter("pool = 0").select("dn", F.col("vwap").alias("leader_vwap")), "dn").select("pool", "dn", "vwap", "leader_vwap")


@query(f"{_DAILY} SELECT pool, dn, count(*) OVER f AS n_ahead, min(CASE WHEN n >= 2 THEN dn END) OVER f - dn AS days_to_busy, round(min(vwap) OVER f / vwap - 1, 9) AS worst FROM daily WINDOW f AS ({_DW} RANGE BETWEEN 1 FOLLOWING AND 30 FOLLOWING)")
def joi_15_future_interval(spark, d):
    f = _days().rangeBetween(1, 30)
    busy = F.min(F.when(F.col("n") >= 2, F.col("dn"))).over(f) - F.col("dn")
    return daily(spark, d).select("pool", "dn", F.count(F.lit(1)).over(f).alias("n_ahead"), busy.alias("days_to_busy"), r(F.min("vwap").over(f) / F.col("vwap") - 1, "worst", 9))


@query(f"{SW} SELECT p_partkey AS token, count(tx) AS flows, round(coalesce(sum(quote) FILTER (direction = 'buy_base'), 0), 2) AS bought, round(coalesce(sum(quote) FILTER (direction = 'sell_base'), 0), 2) AS sold, count(*) FILTER (quote > p_retailprice * 20) AS large FROM part LEFT JOIN swaps ON token = p_partkey GROUP BY 1")
def joi_17_grouped_list(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("token"), "p_retailprice")
    q = lambda way: F.coalesce(F.sum(F.when(F.col("direction") == way, F.col("quote"))), F.lit(0.0))
    large = F.count_if(F.col("quote") > F.col("p_retailprice") * 20)
    return part.join(swaps(spark, d), "token", "left").groupBy("token").agg(F.count("tx").alias("flows"), r(q("buy_base"), "bought", 2), r(q("sell_base"), "sold", 2), large.alias("large"))


@query(f"{TK}, x AS (SELECT event_id, kind, " + ", ".join(f"last_value(CASE WHEN kind = '{k}' THEN price END IGNORE NULLS) OVER ({TORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {k}" for k in KINDS) + " FROM ticks) SELECT event_id, round(list_avg(list_filter([" + ", ".join(f"CASE WHEN kind <> '{k}' THEN {k} END" for k in KINDS) + "], lambda v: v IS NOT NULL)), 6) AS others FROM x")
def joi_19_other_latest(spark, d):
    return ticks(spark, d).select("event_id", r(X.others_latest("kind", KINDS, F.col("price"), _tick()), "others"))


# -- grids -------------------------------------------------------------------


@query(f"{TK}, b AS (SELECT symbol, ts_us // {HOUR} AS hour, arg_max(price, (ts_us, event_id)) AS price FROM ticks GROUP BY 1, 2), e AS (SELECT symbol, min(hour) AS lo, max(hour) AS hi FROM b GROUP BY 1), g AS (SELECT symbol, unnest(generate_series(lo, hi)) AS hour FROM e) SELECT symbol, hour, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY hour) AS price, CASE WHEN price IS NULL THEN 'forward_fill' ELSE 'observed' END AS method FROM g LEFT JOIN b USING (symbol, hour)")
def grd_01_hourly_grid(spark, d):
    b = ticks(spark, d).groupBy("symbol", F.expr(f"ts_us div {HOUR}").alias("hour")).agg(F.max_by("price", F.struct("ts_us", "event_id")).alias("price"))
    return G.fill_forward(G.spine(b, ["symbol"], "hour", 1), b, ["symbol"], "hour", "price")


@query(f"{_DAILY}, a AS (SELECT min(dn) AS lo, max(dn) AS hi FROM daily), g AS (SELECT p.pool, m.dn FROM (SELECT DISTINCT pool FROM daily) p, (SELECT unnest(generate_series(lo, hi)) AS dn FROM a) m) SELECT g.pool, g.dn, round(last_value(vwap IGNORE NULLS) OVER w, 6) AS vwap, g.dn - max(daily.dn) OVER w AS stale FROM g LEFT JOIN daily USING (pool, dn) WINDOW w AS (PARTITION BY g.pool ORDER BY g.dn)")
def grd_04_stale_panel(spark, d):
    bars = daily(spark, d)
    span = bars.agg(F.min("dn").alias("lo"), F.max("dn").alias("hi"))  # one row
    days = F.explode(F.sequence("lo", "hi")).alias("dn")
    grid = bars.select("pool").distinct().crossJoin(F.broadcast(span)).select("pool", days)
    so_far = W.rows(_days(), None, 0)
    x = grid.join(bars.withColumn("seen", F.col("dn")), ["pool", "dn"], "left")
    return x.select("pool", "dn", r(F.last("vwap", ignorenulls=True).over(so_far), "vwap"), (F.col("dn") - F.max("seen").over(so_far)).alias("stale"))


@query(f"{_GRID}, f AS (SELECT g.pool, g.dn, last_value(vwap IGNORE NULLS) OVER (PARTITION BY g.pool ORDER BY g.dn) AS p FROM g LEFT JOIN daily USING (pool, dn)) SELECT pool, dn, round(ln(p / lag(p) OVER ({_DW})), 9) AS ret FROM f")
def grd_05_filled_return(spark, d):
    spine, bars = _grid(spark, d)
    return G.fill_forward(spine, bars, ["pool"], "dn", "vwap").select("pool", "dn", r(W.log_return(F.col("vwap"), _days()), "ret", 9))


@query(f"{_DAILY}, b AS (SELECT pool, dn // 7 AS week, arg_max(vwap, dn) AS last, sum(quote) AS quote, quantile_disc(n, 0.5) AS mid_n, bool_or(n >= 2) AS busy FROM daily GROUP BY 1, 2) SELECT pool, week, round(last, 6) AS last, round(ln(last / lag(last) OVER (PARTITION BY pool ORDER BY week)), 9) AS ret, round(quote, 2) AS quote, mid_n, busy FROM b")
def grd_06_coarser_rows(spark, d):
    b = X.coarser(daily(spark, d), ["pool"], "dn", 7, "week", "vwap", [F.sum("quote").alias("quote"), F.expr("percentile_disc(0.5) within group (order by n)").cast("long").alias("mid_n"), F.bool_or(F.col("n") >= 2).alias("busy")])
    return b.select("pool", "week", r("last", "last"), r("ret", "ret", 9), r("quote", "quote", 2), "mid_n", "busy")


@query(f"{TK}, p AS (SELECT DISTINCT kind FROM ticks), q AS (SELECT DISTINCT day FROM ticks), a AS (SELECT kind, day, count(*) AS n, sum(price) AS total FROM ticks WHERE price > 25 GROUP BY 1, 2) SELECT kind, CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS n, round(coalesce(total, 0), 4) AS total FROM p CROSS JOIN q LEFT JOIN a USING (kind, day)")
def grd_10_zero_filled(spark, d):
    t = ticks(spark, d)
    facts = t.filter("price > 25").groupBy("kind", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
    return G.zero_filled(t.select("kind").distinct(), t.select("day").distinct(), facts, ["kind", "day"], ["n", "total"]).select("kind", F.col("day").cast("string").alias("day"), "n", r("total", "total", 4))


@query()
def grd_14_non_overlap(spark, d):
    t = ticks(spark, d).withColumn("exit_us", (F.col("ts_us") + F.col("price") * HOUR).cast("long"))
    return X.non_overlapping(t.select("symbol", "event_id", "ts_us", "exit_us"), ["symbol"], "ts_us", "exit_us", ["event_id"])


# -- labels ------------------------------------------------------------------


@query(f"{TK} SELECT a.event_id, round(10000 * ln(lead(a.price, 3) OVER w / a.price), 4) AS fwd_rows, round(10000 * ln(a.price / lag(a.price, 3) OVER w), 4) AS past_rows, round(10000 * ln(b.price / a.price), 4) AS fwd_clock FROM (SELECT *, ts_us + {24 * HOUR} AS later FROM ticks) a ASOF LEFT JOIN ticks b ON a.symbol = b.symbol AND a.later <= b.ts_us WINDOW w AS (PARTITION BY a.symbol ORDER BY a.ts_us, a.event_id)")
def lbl_03_two_clocks(spark, d):
    t = ticks(spark, d).select("event_id", "symbol", "ts_us", "price")
    bps = lambda a, b: S.natural_log(S.quotient(a, b)) * 10_000
    p = F.col("price")
    x = t.select("*", r(bps(F.lead("price", 3).over(_tick()), p), "fwd_rows", 4), r(bps(p, F.lag("price", 3).over(_tick())), "past_rows", 4)).withColumn("ts_us", F.col("ts_us") + 24 * HOUR)
    y = J.asof_join(x, t.withColumnRenamed("price", "later"), "ts_us", ["symbol"], ["later"], forward=True)
    return y.select("event_id", "fwd_rows", "past_rows", r(bps(F.col("later"), p), "fwd_clock", 4))


@query(f"{_DAILY}, x AS (SELECT pool, dn, ln(vwap / lag(vwap) OVER ({_DW})) AS ret FROM daily), m AS (SELECT dn, avg(ret) AS basket FROM x GROUP BY 1), y AS (SELECT pool, dn, sum(ret) OVER f AS fwd, sum(basket) OVER f AS basket, count(*) OVER f AS k FROM x JOIN m USING (dn) WINDOW f AS ({_DW} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) SELECT pool, dn, round(fwd - basket, 8) AS residual, fwd - basket > 0 AS positive FROM y WHERE k = 5")
def lbl_20_residual_return(spark, d):
    x = daily(spark, d).withColumn("ret", W.log_return(F.col("vwap"), _days()))
    f = W.rows(_days(), 1, 5)
    y = x.join(x.groupBy("dn").agg(F.avg("ret").alias("basket")), "dn").select("pool", "dn", (F.sum("ret").over(f) - F.sum("basket").over(f)).alias("res"), F.count(F.lit(1)).over(f).alias("k"))
    return y.filter("k = 5").select("pool", "dn", r("res", "residual", 8), (F.col("res") > 0).alias("positive"))


@query(f"{_DAILY}, x AS (SELECT s.tx, s.log_index, s.price, s.quote, s.fee, b.vwap AS settle, a.vwap AS before FROM swaps s LEFT JOIN daily b ON b.pool = s.pool AND b.dn = date_diff('day', DATE '1970-01-01', s.day) + 7 LEFT JOIN daily a ON a.pool = s.pool AND a.dn = date_diff('day', DATE '1970-01-01', s.day) + 6) SELECT tx, log_index, CASE WHEN settle IS NULL THEN 'pending' WHEN settle > price THEN 'won' ELSE 'lost' END AS above, CASE WHEN settle IS NULL OR before IS NULL THEN 'pending' WHEN settle >= before THEN 'up' ELSE 'down' END AS move, CASE WHEN settle IS NOT NULL THEN round(CASE WHEN settle > price THEN 2 * quote ELSE 0 END - quote - quote * fee, 4) END AS profit FROM x")
def lbl_22_settlement(spark, d):
    bars = daily(spark, d)
    at = lambda k, name: bars.select("pool", (F.col("dn") - k).alias("dn"), F.col("vwap").alias(name))
    x = swaps(spark, d).withColumn("dn", F.unix_date("day").cast("long")).join(at(7, "settle"), ["pool", "dn"], "left").join(at(6, "before"), ["pool", "dn"], "left")
    return x.select(*ID, *X.settlement(F.col("settle"), F.col("before"), F.col("price"), F.col("quote"), F.col("fee")))


@query(f"{TK}, x AS (SELECT event_id, symbol, price, ts_us, CAST(k AS BIGINT) AS delay, ts_us + k AS at FROM ticks, (VALUES " + ", ".join(f"({k})" for k in DELAYS) + ") v(k)) SELECT x.event_id, x.delay, round(b.price - x.price, 6) AS edge, round(b.price / nullif(x.price, 0) - 1, 9) AS edge_pct, (b.ts_us - x.ts_us) / 1e6 AS wait_s FROM x ASOF LEFT JOIN ticks b ON x.symbol = b.symbol AND x.at <= b.ts_us")
def lbl_23_copy_edge(spark, d):
    t = ticks(spark, d).select("event_id", "symbol", "ts_us", "price")
    return X.copy_edge(t, ["symbol"], "ts_us", "price", DELAYS).select("event_id", "delay", r("edge", "edge"), r("edge_pct", "edge_pct", 9), "wait_s")


# -- factor tests and controls -------------------------------------------------


@query(f"{_DAILY}, s AS (SELECT min(dn) AS lo, max(dn) - min(dn) AS w FROM daily), f AS (SELECT fold, lo + w * a AS train_end, lo + w * b AS valid_end FROM s, (VALUES (1, 0.45, 0.63), (2, 0.60, 0.78), (3, 0.72, 0.94)) v(fold, a, b)) SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (dn <= train_end) AS train, count(*) FILTER (dn > train_end + 10 AND dn <= valid_end) AS valid FROM daily, f GROUP BY 1")
def fac_12_purged_folds(spark, d):
    return X.purged_folds(daily(spark, d), "dn", ((1, 0.45, 0.63), (2, 0.60, 0.78), (3, 0.72, 0.94)), 10).groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "valid").alias("valid"))


_STRATA = {"direction": "direction", "pool": "pool::VARCHAR", "year": "year(day)::VARCHAR", "cost": "(CAST(round(fee * 100) AS BIGINT) // 4)::VARCHAR", "lot": "CAST(floor(base / 10) AS BIGINT)::VARCHAR"}


@query(f"""{_X}, y AS (SELECT * FROM x WHERE fwd IS NOT NULL), v AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT size FROM y)), c AS (SELECT list(size) AS cuts FROM v WHERE list_contains([n * 1 // 3, n * 2 // 3], i)),
 b AS (SELECT y.*, len(list_filter(cuts, lambda q: q < size)) AS bucket FROM y, c), l AS ({" UNION ALL ".join(f"SELECT '{k}' AS stratum, {v} AS value, size, fwd, bucket FROM b" for k, v in _STRATA.items())})
 SELECT stratum, value, count(*) AS n, round(corr(size, fwd), 6) AS pearson, round(avg(fwd) FILTER (bucket = 2), 6) AS high, round(avg(fwd) FILTER (bucket = 0), 6) AS low, round(avg(fwd) FILTER (bucket = 2) - avg(fwd) FILTER (bucket = 0), 6) AS spread FROM l GROUP BY 1, 2 HAVING count(*) >= 30""")
def fac_15_stratified(spark, d):
    """Highest less lowest size bucket in each of five kinds of strata."""
    x = _panel(spark, d).filter("fwd is not null").withColumn("one", F.lit(0))
    x = EV.cut_bucket(x, "size", EV.distinct_cuts(x, "size", ["one"], 3), ["one"])
    value = {"direction": F.col("direction"), "pool": F.col("pool").cast("string"), "year": F.year("day").cast("string"), "cost": F.floor(F.round(F.col("fee") * 100) / 4).cast("string"), "lot": F.floor(F.col("base") / 10).cast("string")}
    return EV.stratified(x, value, "size", "fwd", 3).select("stratum", "value", "n", *(r(c, c) for c in ("pearson", "high", "low", "spread")))


@query(f"{_X}, w AS (SELECT pool, coalesce(corr(size, fwd), 0) AS a, coalesce(corr(base, fwd), 0) AS b, coalesce(corr(fee, fwd), 0) AS c FROM x WHERE day < DATE '2000-01-01' AND fwd IS NOT NULL GROUP BY 1), t AS (SELECT *, abs(a) + abs(b) + abs(c) AS s FROM w) SELECT pool, round(CASE WHEN s < 1e-12 THEN 1 / 3.0 ELSE a / s END, 6) AS size, round(CASE WHEN s < 1e-12 THEN 1 / 3.0 ELSE b / s END, 6) AS base, round(CASE WHEN s < 1e-12 THEN 1 / 3.0 ELSE c / s END, 6) AS fee FROM t")
def fac_21_composite_weights(spark, d):
    train = _panel(spark, d).filter("day < date'2000-01-01' and fwd is not null")
    return X.composite_weights(train, ["size", "base", "fee"], "fwd", ["pool"])


@query(f"{_X}, y AS (SELECT *, lag(fwd) OVER ({ORD}) AS past, row_number() OVER (PARTITION BY pool ORDER BY ts, tx, log_index) AS i, count(*) OVER (PARTITION BY pool) AS k FROM x) SELECT a.pool, round(corr(a.size, a.fwd), 6) AS forward, round(corr(a.size, a.past), 6) AS past, round(corr(a.size, b.fwd), 6) AS reversed FROM y a JOIN y b ON b.pool = a.pool AND b.i = a.k + 1 - a.i GROUP BY 1")
def ctl_06_leak_probes(spark, d):
    return X.leak_probes(_panel(spark, d), "size", "fwd", ["pool"], ["ts", "tx", "log_index"]).select("pool", r("forward", "forward"), r("past", "past"), r("reversed", "reversed"))


@query()
def ctl_02_hash_sign(spark, d):
    return FA.hash_sign(swaps(spark, d), "tx", "quote", 7)


@query()
def grd_16_stratified(spark, d):
    return G.stratified(ticks(spark, d), "day", "event_id", 20, 3).select("day", "event_id")


# -- portfolio ---------------------------------------------------------------

_MODELS = (("mid", 0.0, 0.0), ("maker", 0.0, 2.0), ("taker", 1.0, 5.0), ("stress", 1.5, 5.0))
_TRADES = f"{SW}, t AS (SELECT tx, log_index, pool, {SIGN} * 10000 * (lead(price) OVER ({ORD}) / price - 1) AS gross, 100 * fee AS spread, base / 50 AS part FROM swaps)"


def _trades(spark, d):
    gross = _side() * 10_000 * (F.lead("price").over(_event()) / F.col("price") - 1)
    return swaps(spark, d).select(*ID, "pool", gross.alias("gross"), (F.col("fee") * 100).alias("spread"), (F.col("base") / 50).alias("part"))


@query(_TRADES + " SELECT tx, log_index, model, round(gross - m.s * spread - m.f - CASE WHEN m.s > 0 THEN least(spread * part, 20) ELSE 0 END, 4) AS net FROM t, (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in _MODELS) + ") m(model, s, f)")
def pf_01_cost_models(spark, d):
    return X.cost_models(_trades(spark, d), _MODELS).select(*ID, "model", r("net", "net", 4))


_EXITS = _TRADES + ", e AS (SELECT pool, CAST(tx % 4 AS INTEGER) AS fold, CASE WHEN gross IS NULL THEN 'gap' WHEN gross > 2000 THEN 'tp' WHEN gross < -2000 THEN 'sl' ELSE 'timeout' END AS reason, gross FROM t)"


def _exits(spark, d):
    g = F.col("gross")
    reason = F.when(g.isNull(), "gap").when(g > 2000, "tp").when(g < -2000, "sl").otherwise("timeout")
    return _trades(spark, d).select("pool", F.pmod("tx", F.lit(4)).cast("int").alias("fold"), reason.alias("reason"), "gross")


@query(_EXITS + " SELECT pool, reason, fold, count(*) AS n, round(sum(gross), 2) AS pnl, round(avg(gross), 4) AS mean FROM e GROUP BY GROUPING SETS ((pool, reason, fold), (pool, reason))")
def pf_04_exit_reasons(spark, d):
    x = _exits(spark, d)
    sets = [[F.col("pool"), F.col("reason"), F.col("fold")], [F.col("pool"), F.col("reason")]]
    return x.groupingSets(sets, "pool", "reason", "fold").agg(F.count(F.lit(1)).alias("n"), r(F.sum("gross"), "pnl", 2), r(F.avg("gross"), "mean", 4))


@query(_EXITS + " SELECT pool, " + ", ".join(f"round(coalesce(sum(gross) FILTER (fold = {k}), 0), 2) AS fold_{k}" for k in range(4)) + ", " + " AND ".join(f"coalesce(sum(gross) FILTER (fold = {k}), 0) >= 0" for k in range(4)) + " AS stable FROM e GROUP BY pool")
def pf_05_fold_stability(spark, d):
    wide = _exits(spark, d).groupBy("pool").pivot("fold", list(range(4))).agg(F.sum("gross")).fillna(0.0)
    stable = F.lit(True)
    for k in range(4):
        stable = stable & (F.col(f"{k}") >= 0)
    return wide.select("pool", *(r(f"{k}", f"fold_{k}", 2) for k in range(4)), stable.alias("stable"))


@query(_TRADES + ", g AS (SELECT pool, cut, count(*) AS n, sum(gross - cost) AS pnl, avg(gross - cost) AS mean FROM t, (VALUES (0, 0), (0, 5), (3, 0), (3, 5), (6, 0), (6, 5)) v(cut, cost) WHERE gross IS NOT NULL AND spread >= cut GROUP BY pool, cut, cost), k AS (SELECT cut, count(*) AS pools, sum(pnl) AS pnl FROM g GROUP BY cut) SELECT CAST(cut AS INTEGER) AS cut, pools, round(pnl, 2) AS pnl, rank() OVER (ORDER BY pnl DESC) AS place FROM k")
def pf_16_sweep(spark, d):
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("cut"), F.lit(b).alias("cost")) for a in (0, 3, 6) for b in (0, 5)))).alias("g")
    x = _trades(spark, d).filter("gross is not null").select("pool", "gross", "spread", grid).select("*", "g.*").filter("spread >= cut")
    by = x.groupBy("pool", "cut", "cost").agg(F.sum(F.col("gross") - F.col("cost")).alias("pnl")).groupBy("cut").agg(F.count(F.lit(1)).alias("pools"), F.sum("pnl").alias("pnl"))
    return by.select("cut", "pools", r("pnl", "pnl", 2), F.rank().over(Window.orderBy(F.desc("pnl"))).cast("long").alias("place"))  # one row a setting


# -- options and prediction markets --------------------------------------------


@query(f"{_DAILY}, x AS (SELECT pool, dn, vwap, ln(vwap / lag(vwap) OVER ({_DW})) AS ret FROM daily) SELECT pool, dn, " + ", ".join(f"CASE WHEN count(ret) OVER w{k} >= {max(2, k // 3)} THEN round(sqrt(sum(ret * ret) OVER w{k}), 7) END AS rv_{k}" for k in (6, 36, 72)) + ", round(ln(max(vwap) OVER w36 / min(vwap) OVER w36), 7) AS log_range FROM x WINDOW " + ", ".join(f"w{k} AS ({_DW} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (6, 36, 72)))
def opt_02_index_features(spark, d):
    x = daily(spark, d).withColumn("ret", W.log_return(F.col("vwap"), _days()))
    f = {k: W.rows(_days(), 1 - k, 0) for k in (6, 36, 72)}
    rv = [r(F.when(F.count("ret").over(w) >= max(2, k // 3), F.sqrt(F.sum(F.col("ret") * F.col("ret")).over(w))), f"rv_{k}", 7) for k, w in f.items()]
    return x.select("pool", "dn", *rv, r(F.log(F.max("vwap").over(f[36]) / F.min("vwap").over(f[36])), "log_range", 7))


@query(f"{SW}, s AS (SELECT token, tx % 3 AS lookback, avg(fee) * 10 AS prob, avg(price) / 1000 - 1 AS edge FROM swaps GROUP BY 1, 2) SELECT token, count(*) = 3 AS all_present, min(edge) > 0 AND count(*) = 3 AS all_positive, round(min(edge), 9) AS robust_edge, round(min(prob), 9) AS prob_lo, round(max(prob), 9) AS prob_hi FROM s GROUP BY token")
def pm_04_lookback_ensemble(spark, d):
    s = swaps(spark, d).groupBy("token", F.pmod("tx", F.lit(3)).alias("lookback")).agg((F.avg("fee") * 10).alias("prob"), (F.avg("price") / 1000 - 1).alias("edge"))
    return X.lookback_ensemble(s, ["token"], 3).select("token", "all_present", "all_positive", r("robust_edge", "robust_edge", 9), r("prob_lo", "prob_lo", 9), r("prob_hi", "prob_hi", 9))


@query(f"{SW}, l AS (SELECT pool, tx, min(base) AS lo, max(base) + 1 AS hi, avg(fee) AS ask FROM swaps GROUP BY 1, 2), n AS (SELECT *, lead(lo) OVER w AS nxt FROM l WINDOW w AS (PARTITION BY pool ORDER BY lo, tx)) SELECT pool, count(*) AS legs, count(*) FILTER (nxt > hi) AS n_gaps, count(*) FILTER (nxt < hi) AS n_overlaps, count(*) FILTER (nxt <> hi) = 0 AS complete, round(sum(ask), 6) AS all_yes_cost, round(count(*) - sum(ask), 6) AS all_no_cost FROM n GROUP BY pool")
def pm_06_basket(spark, d):
    legs = swaps(spark, d).groupBy("pool", "tx").agg(F.min("base").alias("lo"), (F.max("base") + 1).alias("hi"), F.avg("fee").alias("ask"))
    return X.basket(legs, ["pool"], "lo", "hi", "ask", ["tx"]).select("pool", "legs", "n_gaps", "n_overlaps", "complete", r("all_yes_cost", "all_yes_cost"), r("all_no_cost", "all_no_cost"))
