"""Further registered queries: windows, labels, factor tests, controls,
portfolio tables and models, each with its SQL oracle where SQL has one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import factors as FA
from tickloom.operators import joins as J
from tickloom.operators import paths as P
from tickloom.operators import walk as WF
from tickloom.operators import windows as W
from tickloom.plans.market import _DAILY, _X, ORD, SW, TK, TORD, _event, _flagged, _panel, _tick, daily, n, query, r
from tickloom.sources.tables import micros, scan, swaps, ticks

SIGN = "CASE direction WHEN 'buy_base' THEN 1 WHEN 'sell_base' THEN -1 ELSE 0 END"
_DW = "PARTITION BY pool ORDER BY dn"
ID = ("tx", "log_index")


def _side():
    return S.side_sign(F.col("direction"))


def _days():
    return Window.partitionBy("pool").orderBy("dn")


# -- windows -----------------------------------------------------------------


@query(f"{_DAILY} SELECT pool, dn, CASE WHEN count(vwap) OVER f = 3 AND dn - min(dn) OVER f = 2 THEN round(sum(vwap) OVER f, 7) END AS total FROM daily WINDOW f AS ({_DW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def win_06_contiguous(spark, d):
    return daily(spark, d).select("pool", "dn", r(W.contiguous_sum(F.col("vwap"), F.col("dn"), _days(), 3, 1), "total", 7))


@query(f"{SW} SELECT tx, log_index, CASE WHEN count(price) OVER f >= 7 AND stddev_pop(price) OVER f > 0 THEN round((price - avg(price) OVER f) / stddev_pop(price) OVER f, 6) END AS z FROM swaps WINDOW f AS ({ORD} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)")
def win_08_zscore_inclusive(spark, d):
    return swaps(spark, d).select(*ID, r(W.zscore(F.col("price"), _event(), 28, 7, inclusive=True), "z"))


@query(f"{TK} SELECT event_id, CASE WHEN count(price) OVER f >= 10 THEN round(quantile_cont(price, 0.9) OVER f, 6) END AS q FROM ticks WINDOW f AS (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING)")
def win_16_time_quantile(spark, d):
    f = W.time_frame(["symbol"], "ts_us", -604_800_000_000, -1)
    return ticks(spark, d).select("event_id", r(F.when(F.count("price").over(f) >= 10, F.percentile("price", 0.9).over(f)), "q"))


@query(f"{SW} SELECT tx, log_index, CASE WHEN count(price) OVER f = 5 THEN round((" + " + ".join(f"coalesce(lag(price, {k}) OVER w, 0) * exp(-{k} / 2.0)" for k in range(5)) + ") / (" + " + ".join(f"exp(-{k} / 2.0)" for k in range(5)) + f"), 6) END AS y FROM swaps WINDOW w AS ({ORD}), f AS ({ORD} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def win_18_impulse_decay(spark, d):
    return swaps(spark, d).select(*ID, r(W.impulse_decay(F.col("price"), _event(), 5), "y"))


@query(f"{TK}, x AS (SELECT *, price - lag(price) OVER ({TORD}) AS ch FROM ticks), s AS (SELECT *, last_value(CASE WHEN ch <> 0 THEN sign(ch) END IGNORE NULLS) OVER ({TORD} ROWS UNBOUNDED PRECEDING) AS s FROM x), f AS (SELECT *, CASE WHEN s <> lag(s) OVER ({TORD}) THEN 1 ELSE 0 END AS f FROM s) SELECT event_id, CAST(sum(f) OVER ({TORD} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS sign_changes FROM f")
def win_20_sign_changes(spark, d):
    x = ticks(spark, d).withColumn("ch", F.col("price") - F.lag("price").over(_tick()))
    return W.sign_changes(x, "ch", ["symbol"], ["ts_us", "event_id"], 20).select("event_id", F.col("sign_changes").cast("long"))


_SEEN = f"{TK}, x AS (SELECT *, row_number() OVER ({TORD}) AS i FROM ticks), j AS (SELECT a.event_id, count(*) AS m, sum(CASE WHEN b.price < a.price THEN 1.0 WHEN b.price = a.price THEN 0.5 ELSE 0 END) AS s FROM x a JOIN x b ON a.symbol = b.symbol AND b.i {{op}} a.i AND b.price IS NOT NULL WHERE a.price IS NOT NULL GROUP BY 1) SELECT x.event_id, CASE WHEN m >= {{least}} THEN round(s / m, 9) END AS pct FROM x LEFT JOIN j USING (event_id)"


@query(_SEEN.format(op="<", least=5))
def win_22_percentile_past(spark, d):
    return P.expanding_percentile(ticks(spark, d), ["symbol"], ["ts_us", "event_id"], "price", 5).select("event_id", r("pct", "pct", 9))


@query(_SEEN.format(op="<=", least=24))
def win_23_percentile_inclusive(spark, d):
    return P.expanding_percentile(ticks(spark, d), ["symbol"], ["ts_us", "event_id"], "price", 24, inclusive=True).select("event_id", r("pct", "pct", 9))


@query(f"{TK}, x AS (SELECT *, price > avg(price) OVER (PARTITION BY symbol) AS up FROM ticks) SELECT event_id FROM x QUALIFY up AND NOT coalesce(lag(up) OVER ({TORD}), false)")
def win_31_episode_starts(spark, d):
    x = _flagged(spark, d).withColumn("before", F.coalesce(F.lag("up").over(_tick()), F.lit(False)))
    return x.filter("up and not before").select("event_id")


@query(f"{SW} SELECT tx, log_index, round(price / lag(price, 5) OVER w - 1, 9) AS momentum, round(price - lag(price) OVER w, 6) AS gradient, round(price - 2 * lag(price) OVER w + lag(price, 2) OVER w, 6) AS curvature FROM swaps WINDOW w AS ({ORD})")
def win_32_momentum(spark, d):
    p, back = F.col("price"), lambda k: F.lag("price", k).over(_event())
    return swaps(spark, d).select(*ID, r(S.safe_div(p, back(5)) - 1, "momentum", 9), r(p - back(1), "gradient"), r(p - 2 * back(1) + back(2), "curvature"))


@query(f"{SW}, x AS (SELECT *, ln(price / lag(price) OVER ({ORD})) AS ret FROM swaps) SELECT tx, log_index, round(exp(coalesce(sum(ret) OVER ({ORD} ROWS UNBOUNDED PRECEDING), 0)), 6) AS idx FROM x")
def win_37_price_index(spark, d):
    x = swaps(spark, d).withColumn("ret", W.log_return(F.col("price"), _event()))
    return x.select(*ID, r(F.exp(F.coalesce(F.sum("ret").over(W.rows(_event(), None, 0)), F.lit(0.0))), "idx"))


@query(f"{TK}, x AS (SELECT *, row_number() OVER ({TORD}) AS i, lag(kind) OVER ({TORD}) AS k FROM ticks) SELECT event_id, CAST(i - max(CASE WHEN kind <> k THEN i END) OVER ({TORD} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS since FROM x")
def win_38_since_change(spark, d):
    x = ticks(spark, d).withColumn("i", F.row_number().over(_tick())).withColumn("k", F.lag("kind").over(_tick()))
    return x.select("event_id", n(F.col("i") - F.max(F.when(F.col("kind") != F.col("k"), F.col("i"))).over(W.rows(_tick(), None, 0)), "since"))


# -- labels ------------------------------------------------------------------


@query(f"{SW}, e AS (SELECT *, max(ts) OVER (PARTITION BY pool) AS e FROM swaps), x AS (SELECT *, (max({{'t': ts, 'x': tx, 'i': log_index, 'k': token, 'q': quote, 'p': price}}) OVER f).p AS l, max(price) OVER f AS hi, min(price) OVER f AS lo FROM e WINDOW f AS (PARTITION BY pool ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 30 DAY FOLLOWING)) SELECT tx, log_index, CASE WHEN ts + INTERVAL 30 DAY <= e THEN round(hi / price - 1, 9) END AS draw_up, CASE WHEN ts + INTERVAL 30 DAY <= e THEN round(lo / price - 1, 9) END AS draw_down, CASE WHEN ts + INTERVAL 30 DAY <= e THEN round(l / price - 1, 9) END AS ret FROM x")
def lbl_06_full_window(spark, d):
    x = swaps(spark, d).withColumn("t", F.unix_date("day").cast("long"))
    f, whole = W.time_frame(["pool"], "t", 0, 30), F.col("t") + 30 <= F.max("t").over(Window.partitionBy("pool"))
    last = F.max_by("price", F.struct("t", "tx", "log_index", "token", "quote"))
    part = lambda agg: F.when(whole, S.safe_div(agg.over(f), F.col("price")) - 1)
    return x.select(*ID, r(part(F.max("price")), "draw_up", 9), r(part(F.min("price")), "draw_down", 9), r(part(last), "ret", 9))


@query(f"{SW}, x AS (SELECT tx, log_index, {SIGN} * (lead(price, 2) OVER w / price - 1) AS s, {SIGN} * (lead(price, 12) OVER w / price - 1) AS l FROM swaps WINDOW w AS ({ORD})) SELECT tx, log_index, CASE WHEN s IS NULL OR l IS NULL THEN 'insufficient' WHEN abs(l) < 0.1 AND abs(s) >= 0.1 THEN 'whipsaw' WHEN abs(l) < 0.1 THEN 'flat' WHEN sign(s) * sign(l) < 0 THEN 'reversal' ELSE 'continuation' END AS label FROM x")
def lbl_07_path_class(spark, d):
    move = lambda k: _side() * (S.safe_div(F.lead("price", k).over(_event()), F.col("price")) - 1)
    x = swaps(spark, d).select(*ID, move(2).alias("s"), move(12).alias("l"))
    return x.select(*ID, P.path_class(F.col("s"), F.col("l"), 0.1).alias("label"))


_HITS = f"{SW}, x AS (SELECT *, list(price) OVER ({ORD} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS path FROM swaps)"


@query(f"{_HITS}, y AS (SELECT tx, log_index, list_position(list_transform(path, lambda p: p >= price * 1.2), true) AS up, list_position(list_transform(path, lambda p: p <= price * 0.8), true) AS dn FROM x) SELECT tx, log_index, CASE WHEN up IS NOT NULL AND (dn IS NULL OR up < dn) THEN 'upper' WHEN dn IS NOT NULL THEN 'lower' ELSE 'none' END AS label, CAST(least(up, dn) AS BIGINT) AS steps FROM y")
def lbl_10_first_hit(spark, d):
    p = F.col("price")
    x = swaps(spark, d).withColumn("path", P.ahead(p, _event(), 20))
    x = x.withColumn("up", P.first_hit(F.col("path"), lambda v: v >= p * 1.2)).withColumn("dn", P.first_hit(F.col("path"), lambda v: v <= p * 0.8))
    return x.select(*ID, P.barrier(F.col("up"), F.col("dn")).alias("label"), F.least("up", "dn").alias("steps"))


@query(f"{_DAILY}, m AS (SELECT *, abs(vwap - avg(vwap) OVER (PARTITION BY pool)) AS d FROM daily), x AS (SELECT *, list(d) OVER ({_DW} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS path FROM m) SELECT pool, dn, CAST(list_position(list_transform(path, lambda p: p <= d / 2), true) AS BIGINT) AS half_life, CAST(list_position(list_transform(path, lambda p: p <= 50), true) AS BIGINT) AS reentry, round(list_max(path), 6) AS worst FROM x")
def lbl_13_half_life(spark, d):
    x = daily(spark, d).withColumn("d", F.abs(F.col("vwap") - F.avg("vwap").over(Window.partitionBy("pool"))))
    x = x.withColumn("path", P.ahead(F.col("d"), _days(), 20))
    return x.select("pool", "dn", P.first_hit(F.col("path"), lambda v: v <= F.col("d") / 2).alias("half_life"), P.first_hit(F.col("path"), lambda v: v <= 50).alias("reentry"), r(F.array_max("path"), "worst"))


@query(f"{_DAILY}, m AS (SELECT *, abs(vwap - avg(vwap) OVER (PARTITION BY pool)) AS d FROM daily) SELECT pool, dn, CASE WHEN lead(d, 3) OVER w IS NULL THEN NULL WHEN lead(d, 3) OVER w < 0.8 * d THEN 'shrink' WHEN lead(d, 3) OVER w > 1.2 * d THEN 'expand' ELSE 'flat' END AS label FROM m WINDOW w AS ({_DW})")
def lbl_14_convergence(spark, d):
    x = daily(spark, d).withColumn("d", F.abs(F.col("vwap") - F.avg("vwap").over(Window.partitionBy("pool"))))
    later = F.lead("d", 3).over(_days())
    return x.select("pool", "dn", F.when(later < 0.8 * F.col("d"), "shrink").when(later > 1.2 * F.col("d"), "expand").when(later.isNotNull(), "flat").alias("label"))


# -- factors -----------------------------------------------------------------


@query(f"{_X}, k AS (SELECT pool, row_number() OVER (PARTITION BY pool ORDER BY size, tx, log_index) AS rx, row_number() OVER (PARTITION BY pool ORDER BY fwd, tx, log_index) AS ry FROM x WHERE fwd IS NOT NULL) SELECT pool, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY pool HAVING count(*) >= 5")
def fac_03_ordinal_spearman(spark, d):
    place = lambda c: F.row_number().over(Window.partitionBy("pool").orderBy(c, *ID)).cast("double")
    k = _panel(spark, d).filter("fwd is not null").select("pool", place("size").alias("rx"), place("fwd").alias("ry"))
    return k.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), r(F.corr("rx", "ry"), "rho")).filter("n >= 5")


_SPLIT = f"{_X}, c AS (SELECT quantile_cont(epoch_us(ts), 0.6) AS cut FROM x), t AS (SELECT x.*, epoch_us(ts) <= cut AS train FROM x, c), q AS (SELECT pool, quantile_cont(size, 1.0 / 3) AS a, quantile_cont(size, 2.0 / 3) AS b FROM t WHERE train GROUP BY pool)"


def _train(spark, d):
    x = _panel(spark, d).withColumn("us", micros("ts"))
    cut = x.agg(F.percentile("us", 0.6).alias("cut"))
    return x.join(F.broadcast(cut)).withColumn("train", F.col("us") <= F.col("cut"))  # one row


def _tertiles(t):
    cuts = FA.quantile_cuts(t.filter("train"), "size", ["pool"], [1 / 3, 2 / 3])
    return cuts.select("pool", F.col(cuts.columns[-1])[0].alias("a"), F.col(cuts.columns[-1])[1].alias("b"))


@query(f"{_SPLIT} SELECT tx, log_index, CASE WHEN size <= a THEN 'low' WHEN size >= b THEN 'high' ELSE 'mid' END AS bucket FROM t JOIN q USING (pool) WHERE NOT train")
def fac_08_train_tertiles(spark, d):
    t = _train(spark, d)
    return t.filter("not train").join(_tertiles(t), "pool").select(*ID, F.when(F.col("size") <= F.col("a"), "low").when(F.col("size") >= F.col("b"), "high").otherwise("mid").alias("bucket"))


@query(f"{_X} SELECT direction = 'buy_base' AS flag, count(*) AS n, round(avg(fwd), 9) AS mean, round(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END), 9) AS positive FROM x WHERE fwd IS NOT NULL GROUP BY 1")
def fac_10_binary_groups(spark, d):
    return _panel(spark, d).filter("fwd is not null").groupBy((F.col("direction") == "buy_base").alias("flag")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("fwd"), "mean", 9), r(F.avg((F.col("fwd") > 0).cast("double")), "positive", 9))


@query(f"{_SPLIT} SELECT train, CASE WHEN size <= a THEN 'low' WHEN size >= b THEN 'high' ELSE 'mid' END AS bucket, count(*) AS n, round(avg(fwd), 9) AS target, round(avg(size), 6) AS factor FROM t JOIN q USING (pool) WHERE fwd IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30")
def fac_14_bucket_profile(spark, d):
    t = _train(spark, d)
    b = F.when(F.col("size") <= F.col("a"), "low").when(F.col("size") >= F.col("b"), "high").otherwise("mid")
    return t.filter("fwd is not null").join(_tertiles(t), "pool").groupBy("train", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("fwd"), "target", 9), r(F.avg("size"), "factor")).filter("n >= 30")


@query(f"{_X}, k AS (SELECT pool, day, rank() OVER g + (count(*) OVER (PARTITION BY date_trunc('month', day), size) - 1) / 2.0 AS rx, rank() OVER h + (count(*) OVER (PARTITION BY date_trunc('month', day), fwd) - 1) / 2.0 AS ry FROM x WHERE fwd IS NOT NULL WINDOW g AS (PARTITION BY date_trunc('month', day) ORDER BY size), h AS (PARTITION BY date_trunc('month', day) ORDER BY fwd)), c AS (SELECT date_trunc('month', day) AS m, corr(rx, ry) AS c FROM k GROUP BY 1 HAVING count(*) >= 5) SELECT count(*) AS periods, round(avg(c), 6) AS mean, round(avg(abs(c)), 6) AS mean_abs, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0 END), 6) AS positive FROM c")
def fac_16_period_stability(spark, d):
    x = _panel(spark, d).withColumn("m", F.trunc("day", "month"))
    c = FA.spearman(x, "size", "fwd", ["m"]).filter("n >= 5 and spearman is not null")
    return c.agg(F.count(F.lit(1)).alias("periods"), r(F.avg("spearman"), "mean"), r(F.avg(F.abs("spearman")), "mean_abs"), r(F.avg((F.col("spearman") > 0).cast("double")), "positive"))


@query(f"{_DAILY}, m AS (SELECT dn, sum(quote) / sum(base) AS p, sum(n) * 1.0 AS v FROM daily GROUP BY dn) SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, round(corr(x.v, y.p), 6) AS corr, round(regr_slope(y.p, x.v), 6) AS beta FROM m x CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) t(lag) JOIN m y ON y.dn = x.dn + lag GROUP BY 1")
def fac_27_lead_lag(spark, d):
    m = daily(spark, d).groupBy("dn").agg((F.sum("quote") / F.sum("base")).alias("p"), F.sum("n").cast("double").alias("v"))
    g = J.lag_grid(m.select("dn", "v"), m.select("dn", "p"), "dn", [-2, -1, 0, 1, 2])
    return g.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), r(F.corr("v", "p"), "corr"), r(F.regr_slope("p", "v"), "beta"))


@query(f"{SW}, c AS (SELECT direction = 'buy_base' AS treated, epoch_us(ts) >= (SELECT quantile_cont(epoch_us(ts), 0.5) FROM swaps) AS late, sum(price * quote) / sum(quote) AS m FROM swaps GROUP BY 1, 2) SELECT round(max(m) FILTER (treated AND late) - max(m) FILTER (treated AND NOT late) - max(m) FILTER (NOT treated AND late) + max(m) FILTER (NOT treated AND NOT late), 4) AS effect FROM c")
def fac_30_diff_in_diff(spark, d):
    s = swaps(spark, d).withColumn("us", micros("ts"))
    s = s.join(F.broadcast(s.agg(F.percentile("us", 0.5).alias("mid"))))  # one row
    t, late = F.col("direction") == "buy_base", F.col("us") >= F.col("mid")
    cell = lambda a, b: F.sum(F.when(a & b, F.col("price") * F.col("quote"))) / F.sum(F.when(a & b, F.col("quote")))
    return s.agg(r(cell(t, late) - cell(t, ~late) - cell(~t, late) + cell(~t, ~late), "effect", 4))


# -- controls ----------------------------------------------------------------


@query(f"{_X} SELECT pool, round(avg({SIGN} * fwd) * 1e4, 6) AS net, round(avg(-{SIGN} * fwd) * 1e4, 6) AS reversed FROM x WHERE fwd IS NOT NULL GROUP BY pool")
def ctl_01_sign_reversed(spark, d):
    g = _side() * F.col("fwd")
    return _panel(spark, d).filter("fwd is not null").groupBy("pool").agg(r(F.avg(g) * 1e4, "net"), r(F.avg(-g) * 1e4, "reversed"))


@query(f"{_X}, y AS (SELECT *, lead(size, 7) OVER ({ORD}) AS ahead, lag(size, 60) OVER ({ORD}) AS back FROM x) SELECT pool, round(corr(ahead, fwd), 6) AS ahead, round(corr(back, fwd), 6) AS back FROM y GROUP BY pool HAVING count(*) >= 100")
def ctl_05_shift_placebo(spark, d):
    x = _panel(spark, d).withColumn("a", F.lead("size", 7).over(_event())).withColumn("b", F.lag("size", 60).over(_event()))
    return x.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), r(F.corr("a", "fwd"), "ahead"), r(F.corr("b", "fwd"), "back")).filter("n >= 100").drop("n")


@query(f"{_X}, k AS (SELECT pool, fwd, row_number() OVER (PARTITION BY pool ORDER BY fwd DESC NULLS LAST, tx, log_index) AS i FROM x) SELECT pool, count(fwd) AS n, round(avg(fwd), 9) AS mean FROM k WHERE i > 3 AND fwd IS NOT NULL GROUP BY pool")
def ctl_11_drop_winners(spark, d):
    w = Window.partitionBy("pool").orderBy(F.desc_nulls_last("fwd"), *ID)
    return _panel(spark, d).withColumn("i", F.row_number().over(w)).filter("i > 3 and fwd is not null").groupBy("pool").agg(F.count("fwd").alias("n"), r(F.avg("fwd"), "mean", 9))


@query(f"{_X}, g AS (SELECT {SIGN} * fwd * 1e4 AS g, CAST(c AS INTEGER) AS cost FROM x CROSS JOIN (VALUES (0), (10), (100)) t(c) WHERE fwd IS NOT NULL AND direction <> 'unknown'), k AS (SELECT *, row_number() OVER (PARTITION BY cost ORDER BY g) AS i, count(*) OVER (PARTITION BY cost) AS n FROM g) SELECT cost, round(avg(g - cost), 4) AS mean, round(quantile_cont(g - cost, 0.5), 4) AS median, round(avg(CASE WHEN g > cost THEN 1.0 ELSE 0 END), 9) AS above, round(avg(g - cost) FILTER (g > cost), 4) AS excess, round(avg(cost - g) FILTER (g <= cost), 4) AS shortfall, round(avg(g - cost) FILTER (i <= ceil(n * 0.05)), 4) AS tail_mean, round(avg(CASE WHEN g > cost THEN 1.0 ELSE 0 END) * coalesce(avg(g - cost) FILTER (g > cost), 0) - avg(CASE WHEN g > cost THEN 0 ELSE 1.0 END) * coalesce(avg(cost - g) FILTER (g <= cost), 0), 4) AS edge FROM k GROUP BY cost")
def ctl_12_cost_stress(spark, d):
    x = _panel(spark, d).filter("fwd is not null and direction != 'unknown'").select((_side() * F.col("fwd") * 1e4).alias("g"), F.explode(F.array(*map(F.lit, (0, 10, 100)))).alias("cost"))
    net, up = F.col("g") - F.col("cost"), F.col("g") > F.col("cost")
    share = F.avg(up.cast("double"))
    edge = share * F.coalesce(F.avg(F.when(up, net)), F.lit(0.0)) - (1 - share) * F.coalesce(F.avg(F.when(~up, -net)), F.lit(0.0))
    # a cost moves all rows alike, so their order and its points are found once
    order = WF.points(_panel(spark, d).filter("fwd is not null and direction != 'unknown'").select((_side() * F.col("fwd") * 1e4).alias("x")), [], {"median": 0.5}, {"tail_mean": 0.05}, few=True)
    tail = order.select(F.explode(F.array(*map(F.lit, (0, 10, 100)))).alias("cost"), "*").select("cost", *(r(F.col(c) - F.col("cost"), c, 4) for c in ("median", "tail_mean")))
    return x.groupBy("cost").agg(r(edge, "edge", 4), r(F.avg(net), "mean", 4), r(F.avg(up.cast("double")), "above", 9), r(F.avg(F.when(up, net)), "excess", 4), r(F.avg(F.when(~up, -net)), "shortfall", 4)).join(tail, "cost")


# -- portfolio ---------------------------------------------------------------

_PNL = f"{_X}, p AS (SELECT pool, day, ts, tx, log_index, direction, {SIGN} * fwd * quote AS pnl, quote FROM x WHERE fwd IS NOT NULL AND direction <> 'unknown')"


def _trades(spark, d):
    return _panel(spark, d).filter("fwd is not null and direction != 'unknown'").withColumn("pnl", _side() * F.col("fwd") * F.col("quote"))


#: amounts end in a few digits, half a unit of the last place among them; this
#: moves them off the point where rounding hangs on the last bit
_OFF = 1.234567e-5


@query(f"""{_PNL}, g AS (SELECT pool, day, count(*) AS trades, sum(pnl) AS pnl, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate, sum(quote) AS turnover, max(pnl) AS best, min(pnl) AS worst FROM p GROUP BY 1, 2),
 z AS (SELECT pool, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM g GROUP BY pool), f AS (SELECT z.pool, z.day, coalesce(trades, 0) AS trades, coalesce(pnl, 0) AS pnl, win_rate, coalesce(turnover, 0) AS turnover, best, worst FROM z LEFT JOIN g ON g.pool = z.pool AND g.day = z.day),
 e AS (SELECT *, sum(pnl) OVER w AS equity FROM f WINDOW w AS (PARTITION BY pool ORDER BY day))
 SELECT pool, day, trades, round(pnl, 7) AS pnl, round(win_rate, 9) AS win_rate, round(turnover, 7) AS turnover, round(best, 7) AS best, round(worst, 7) AS worst, round(equity + {_OFF}, 4) AS equity, round(greatest(max(equity) OVER (PARTITION BY pool ORDER BY day), 0) - equity + {_OFF}, 4) AS drawdown FROM e""")
def pf_02_daily_pnl(spark, d):
    """Every day from a pool's first trade to its last, quiet ones with zeros,
    and the drawdown of what was earned so far."""
    g = _trades(spark, d).groupBy("pool", "day").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.sum("quote").alias("turnover"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"))
    spine = g.groupBy("pool").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("pool", F.explode(F.sequence("a", "b")).alias("day"))
    f = spine.join(g, ["pool", "day"], "left").na.fill(0, ["trades"]).na.fill(0.0, ["pnl", "turnover"])
    w = W.rows(Window.partitionBy("pool").orderBy("day"), None, 0)
    e = f.withColumn("equity", F.sum("pnl").over(w)).withColumn("drawdown", F.greatest(F.max("equity").over(w), F.lit(0.0)) - F.col("equity"))
    return e.select("pool", "day", "trades", r("pnl", "pnl", 7), r("win_rate", "win_rate", 9), r("turnover", "turnover", 7), r("best", "best", 7), r("worst", "worst", 7), r(F.col("equity") + _OFF, "equity", 4), r(F.col("drawdown") + _OFF, "drawdown", 4))


@query(f"{_PNL}, q AS (SELECT *, year(day)::VARCHAR AS fold FROM p) SELECT pool, coalesce(fold, 'all') AS fold, count(*) AS trades, round(sum(pnl) + {_OFF}, 4) AS total, round(quantile_cont(pnl, 0.5) + {_OFF}, 4) AS median, round(quantile_cont(pnl, 0.05) + {_OFF}, 4) AS p5, CASE WHEN sum(greatest(-pnl, 0)) > 0 THEN round(sum(greatest(pnl, 0)) / sum(greatest(-pnl, 0)), 6) END AS profit_factor, round(count(*) * 1.0 / count(DISTINCT day), 6) AS per_day FROM q GROUP BY GROUPING SETS ((pool, fold), (pool))")
def pf_03_summary(spark, d):
    """Per pool and year, and per pool over all years."""
    gain = lambda c: F.sum(F.greatest(c, F.lit(0.0)))
    t = _trades(spark, d).withColumn("fold", F.year("day").cast("string"))
    g = t.groupingSets([["pool", "fold"], ["pool"]], "pool", "fold").agg(F.count(F.lit(1)).alias("trades"), r(F.sum("pnl") + _OFF, "total", 4), r(F.percentile("pnl", 0.5) + _OFF, "median", 4), r(F.percentile("pnl", 0.05) + _OFF, "p5", 4), r(S.safe_div(gain(F.col("pnl")), gain(-F.col("pnl"))), "profit_factor"), r(F.count(F.lit(1)) / F.count_distinct("day"), "per_day"))
    return g.withColumn("fold", F.coalesce("fold", F.lit("all")))


@query(f"{_PNL}, s AS (SELECT pool, sum(pnl) AS t FROM p GROUP BY pool) SELECT count(*) AS configs, round(max(t), 4) AS best, round(quantile_cont(t, 0.5), 4) AS median, round(min(t), 4) AS worst, round(avg(CASE WHEN t > 0 THEN 1.0 ELSE 0 END), 9) AS positive FROM s")
def pf_06_sensitivity(spark, d):
    s = _trades(spark, d).groupBy("pool").agg(F.sum("pnl").alias("t"))
    return s.agg(F.count(F.lit(1)).alias("configs"), r(F.max("t"), "best", 4), r(F.percentile("t", 0.5), "median", 4), r(F.min("t"), "worst", 4), r(F.avg((F.col("t") > 0).cast("double")), "positive", 9))


@query(f"{_PNL}, s AS (SELECT pool, day, abs(sum(pnl)) AS a FROM p GROUP BY 1, 2) SELECT pool, CASE WHEN sum(a) > 0 THEN round(max(a) / sum(a), 9) END AS top_day FROM s GROUP BY pool")
def pf_07_single_day(spark, d):
    s = _trades(spark, d).groupBy("pool", "day").agg(F.abs(F.sum("pnl")).alias("a"))
    return s.groupBy("pool").agg(r(S.safe_div(F.max("a"), F.sum("a")), "top_day", 9))


@query(f"{SW}, x AS (SELECT pool, ts, lag(ts) OVER ({ORD}) + INTERVAL 3 DAY AS e FROM swaps) SELECT pool, count(*) FILTER (ts < e) AS overlaps FROM x GROUP BY pool")
def pf_08_overlaps(spark, d):
    e = F.lag("ts").over(_event()) + F.expr("interval 3 days")
    return swaps(spark, d).withColumn("e", e).groupBy("pool").agg(F.count_if(F.col("ts") < F.col("e")).alias("overlaps"))


@query(f"{SW}, t AS (SELECT concat_ws('+', CASE WHEN quote > 50000 THEN 'large' END, CASE WHEN fee > 0.05 THEN 'costly' END, CASE WHEN direction = 'buy_base' THEN 'buy' END) AS flags, quote FROM swaps) SELECT flags, count(*) AS n, round(avg(quote), 4) AS mean FROM t GROUP BY flags")
def pf_13_membership(spark, d):
    flags = F.concat_ws("+", F.when(F.col("quote") > 50000, "large"), F.when(F.col("fee") > 0.05, "costly"), F.when(F.col("direction") == "buy_base", "buy"))
    return swaps(spark, d).groupBy(flags.alias("flags")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("quote"), "mean", 4))


@query(f"{SW}, x AS (SELECT min(price) OVER ({ORD} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) / price - 1 AS mae, lead(price, 10) OVER ({ORD}) / price - 1 AS net FROM swaps) SELECT CAST(level AS DOUBLE) AS level, round(avg(CASE WHEN mae <= -level THEN 1.0 ELSE 0 END), 9) AS reached, round(avg(net) FILTER (mae <= -level), 9) AS mean, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) FILTER (mae <= -level), 9) AS recovered, round(quantile_cont(net, 0.5) FILTER (mae <= -level), 9) AS median, round(avg(net) FILTER (mae <= -level AND i <= ceil(m * 0.05)), 9) AS tail_mean FROM (SELECT *, row_number() OVER (PARTITION BY level, mae <= -level ORDER BY net) AS i, count(*) OVER (PARTITION BY level, mae <= -level) AS m FROM x CROSS JOIN (VALUES (0.1), (0.2), (0.4)) t(level) WHERE net IS NOT NULL) GROUP BY 1")
def pf_15_adverse_excursions(spark, d):
    x = swaps(spark, d).select((S.safe_div(F.min("price").over(W.rows(_event(), 1, 10)), F.col("price")) - 1).alias("mae"), (S.safe_div(F.lead("price", 10).over(_event()), F.col("price")) - 1).alias("net"))
    x = x.filter("net is not null").withColumn("level", F.explode(F.array(*map(F.lit, (0.1, 0.2, 0.4)))))
    hit = F.col("mae") <= -F.col("level")
    worst = WF.points(x.filter(hit).select("level", F.col("net").alias("x")), ["level"], {"median": 0.5}, {"tail_mean": 0.05}, few=True).select("level", r("median", "median", 9), r("tail_mean", "tail_mean", 9))
    return x.groupBy("level").agg(r(F.avg(hit.cast("double")), "reached", 9), r(F.avg(F.when(hit, F.col("net"))), "mean", 9), r(F.avg(F.when(hit, (F.col("net") > 0).cast("double"))), "recovered", 9)).join(worst, "level", "left")


# -- order and sets ----------------------------------------------------------


@query(f"{SW} SELECT pool FROM swaps GROUP BY pool HAVING sum(quote) > 100000 EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def srt_07_difference(spark, d):
    big = swaps(spark, d).groupBy("pool").agg(F.sum("quote").alias("q")).filter("q > 100000").select("pool")
    return big.subtract(scan(spark, d, "supplier").filter("s_acctbal < 0").select("s_suppkey"))


# -- models ------------------------------------------------------------------


@query(f"{_SPLIT}, s AS (SELECT pool, avg(size) AS m, stddev_pop(size) AS sd FROM t WHERE train GROUP BY pool) SELECT tx, log_index, round(greatest(-5, least(5, CASE WHEN sd > 0 THEN coalesce((size - m) / sd, 0) ELSE 0 END)), 6) AS z FROM t JOIN s USING (pool)")
def mlm_01_standardise(spark, d):
    t = _train(spark, d)
    s = t.filter("train").groupBy("pool").agg(F.avg("size").alias("m"), F.stddev_pop("size").alias("sd"))
    z = F.coalesce(S.safe_div(F.col("size") - F.col("m"), F.col("sd")), F.lit(0.0))
    return t.join(s, "pool").select(*ID, r(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z)), "z"))


@query()
def mlm_02_ridge_logistic(spark, d):
    """Fitted on the earlier rows; scores of the later ones."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    t = _train(spark, d).filter("fwd is not null").withColumn("label", (F.col("fwd") > 0).cast("double"))
    t = VectorAssembler(inputCols=["size", "fee", "base"], outputCol="features", handleInvalid="skip").transform(t)
    model = LogisticRegression(regParam=0.01, elasticNetParam=0.0).fit(t.filter("train"))
    from pyspark.ml.functions import vector_to_array

    return model.transform(t.filter("not train")).select(*ID, r(vector_to_array("probability")[1], "p"))


@query()
def mlm_05_principal_scores(spark, d):
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=["base", "quote", "fee", "price"], outputCol="v", handleInvalid="skip").transform(swaps(spark, d))
    x = StandardScaler(inputCol="v", outputCol="z", withMean=True).fit(x).transform(x)
    return PCA(k=2, inputCol="z", outputCol="s").fit(x).transform(x).select(*ID, r(vector_to_array("s")[0], "pc1"), r(vector_to_array("s")[1], "pc2"))
