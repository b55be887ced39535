"""Windows, labels, factor tests and trade sets in full, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import factors as FA
from tickloom.operators import measures as ME
from tickloom.operators import minute as M
from tickloom.operators import paths as P
from tickloom.operators import select as X
from tickloom.operators import windows as W
from tickloom.plans.market import _DAILY, KEY, ORD, SW, TK, TORD, _event, _tick, daily, query, r
from tickloom.plans.state import QT, SIGN
from tickloom.sources.tables import micros, quotes, scan, swaps, ticks

ID = ("tx", "log_index")
DAY = 86_400_000_000
_DW = "PARTITION BY pool ORDER BY dn"


def _days():
    return Window.partitionBy("pool").orderBy("dn")


def _side():
    return S.side_sign(F.col("direction"))


# -- windows -----------------------------------------------------------------


@query(f"""{SW}, x AS (SELECT tx, log_index, price, lag(price) OVER w AS prev_price, lead(price) OVER w AS next_price, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) AS BIGINT) AS gap, tx - lag(tx) OVER w AS blocks FROM swaps WINDOW w AS (PARTITION BY pool ORDER BY ts, tx, log_index))
 SELECT tx, log_index, prev_price, next_price, CASE WHEN gap > 0 THEN gap / 1e6 END AS seconds, CASE WHEN blocks > 0 THEN blocks END AS blocks, round(price - prev_price, 9) AS tick_move FROM x""")
def win_01_lag_lead(spark, d):
    gap, blocks = micros("ts") - F.lag(micros("ts")).over(_event()), F.col("tx") - F.lag("tx").over(_event())
    prev = F.lag("price").over(_event())
    return swaps(spark, d).select(*ID, prev.alias("prev_price"), F.lead("price").over(_event()).alias("next_price"), F.when(gap > 0, gap / 1e6).alias("seconds"), F.when(blocks > 0, blocks).alias("blocks"), r(F.col("price") - prev, "tick_move", 9))


@query(f"""{SW}, x AS (SELECT *, {SIGN} AS sg, ln(price / lag(price) OVER ({ORD})) AS ret FROM swaps) SELECT tx, log_index, round(count(*) FILTER (sg = 1) OVER f / NULLIF(count(*) FILTER (sg <> 0) OVER f, 0), 6) AS buy_ratio, round(sum(sg * quote) OVER f, 4) AS net_flow, round(sum(quote) OVER f, 4) AS volume, CASE WHEN count(ret) OVER f >= 2 THEN round(stddev_pop(ret) OVER f, 6) END AS std FROM x WINDOW f AS ({ORD} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def win_03_past_rolling(spark, d):
    f = W.rows(_event(), -20, -1)
    x = swaps(spark, d).withColumn("sg", _side()).withColumn("ret", W.log_return(F.col("price"), _event()))
    ratio = S.safe_div(F.count_if(F.col("sg") == 1).over(f), F.count_if(F.col("sg") != 0).over(f))
    return x.select(*ID, r(ratio, "buy_ratio"), r(F.sum(F.col("sg") * F.col("quote")).over(f), "net_flow", 4), r(F.sum("quote").over(f), "volume", 4), r(W.past_std(F.col("ret"), _event(), 20), "std"))


@query(f"{TK} SELECT event_id, count(*) OVER f AS n, round(coalesce(sum(price) OVER f, 0), 6) AS total, round(avg(price) OVER f, 6) AS mean, round(quantile_cont(price, 0.5) OVER f, 6) AS median FROM ticks WINDOW f AS (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN {DAY - 1} PRECEDING AND 1 PRECEDING)")
def win_14_time_left_closed(spark, d):
    """(t − 1 day, t)."""
    f = W.time_frame(["symbol"], "ts_us", -(DAY - 1), -1)
    return ticks(spark, d).select("event_id", F.count(F.lit(1)).over(f).alias("n"), r(F.coalesce(F.sum("price").over(f), F.lit(0.0)), "total"), r(F.avg("price").over(f), "mean"), r(F.percentile("price", 0.5).over(f), "median"))


@query(f"{TK} SELECT event_id, max(price) OVER f AS hi, min(price) OVER f AS lo, round(avg(price) OVER f, 6) AS mean, round(sum(price) OVER f, 6) AS total FROM ticks WINDOW f AS (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)")
def win_15_time_inclusive(spark, d):
    f = W.time_frame(["symbol"], "ts_us", -DAY, 0)
    return ticks(spark, d).select("event_id", F.max("price").over(f).alias("hi"), F.min("price").over(f).alias("lo"), r(F.avg("price").over(f), "mean"), r(F.sum("price").over(f), "total"))


@query(f"{SW}, x AS (SELECT *, {SIGN} * quote AS s FROM swaps), m AS (SELECT tx, log_index, sum(greatest(s, 0)) OVER f AS p, sum(greatest(-s, 0)) OVER f AS q FROM x WINDOW f AS ({ORD} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT tx, log_index, round(p - q, 4) AS net, CASE WHEN p + q > 0 THEN round((p - q) / sqrt(p + q), 4) END AS balance, round(sign(p - q) * (p + q), 4) AS signed_total, CASE WHEN p > 0 AND q > 0 THEN round(ln(p / q), 6) END AS log_ratio FROM m")
def win_17_signed_memory(spark, d):
    s, f = _side() * F.col("quote"), W.rows(_event(), -19, 0)
    m = W.signed_memory(s, f)
    ratio = S.log_ratio(F.sum(F.greatest(s, F.lit(0.0))).over(f), F.sum(F.greatest(-s, F.lit(0.0))).over(f))
    return swaps(spark, d).select(*ID, r(m["net"], "net", 4), r(m["balance"], "balance", 4), r(m["signed_total"], "signed_total", 4), r(ratio, "log_ratio"))


@query(f"""{_DAILY}, x AS (SELECT *, vwap > lag(vwap) OVER w AS up, CASE WHEN dn - lag(dn) OVER w > 2 OR NOT coalesce(vwap > lag(vwap) OVER w, false) THEN 1 ELSE 0 END AS brk FROM daily WINDOW w AS ({_DW})), i AS (SELECT *, sum(brk) OVER ({_DW}) AS i FROM x) SELECT pool, dn, least(5, count(*) FILTER (coalesce(up, false)) OVER (PARTITION BY pool, i ORDER BY dn)) AS run FROM i""")
def win_19_run_length(spark, d):
    """Rising days in a row, at most 5, broken by a gap of more than two days."""
    w = _days()
    up = F.coalesce(F.col("vwap") > F.lag("vwap").over(w), F.lit(False))
    broken = F.coalesce(F.col("dn") - F.lag("dn").over(w) > 2, F.lit(False)) | ~up
    return ME.capped_run(daily(spark, d).withColumns({"up": up, "broken": broken}), ["pool"], ["dn"], "up", "broken", 5).select("pool", "dn", "run")


def _rsi_sql(n):
    return f"avg(greatest(ch, 0)) FILTER (ch IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts_us, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS u{n}, avg(greatest(-ch, 0)) FILTER (ch IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts_us, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS d{n}"


def _rsi_of(n):
    return f"CASE WHEN u{n} IS NULL THEN 50.0 WHEN d{n} = 0 THEN CASE WHEN u{n} = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + u{n} / d{n}) END"


@query(f"{TK}, x AS (SELECT *, price - lag(price) OVER ({TORD}) AS ch FROM ticks), a AS (SELECT symbol, ts_us, event_id, {_rsi_sql(14)}, {_rsi_sql(42)} FROM x), b AS (SELECT symbol, ts_us, event_id, {_rsi_of(14)} AS fast, {_rsi_of(42)} AS slow FROM a) SELECT event_id, round(fast, 6) AS fast, round(slow, 6) AS slow, round(fast - slow, 6) AS gap, round(fast - slow - lag(fast - slow) OVER ({TORD}), 6) AS delta FROM b")
def win_33_rsi(spark, d):
    x = ticks(spark, d).withColumn("ch", F.col("price") - F.lag("price").over(_tick()))
    x = x.withColumns({"fast": W.rsi(F.col("ch"), _tick(), 14), "slow": W.rsi(F.col("ch"), _tick(), 42)}).withColumn("gap", F.col("fast") - F.col("slow"))
    return x.select("event_id", r("fast", "fast"), r("slow", "slow"), r("gap", "gap"), r(F.col("gap") - F.lag("gap").over(_tick()), "delta"))


@query(f"{SW}, x AS (SELECT *, ln(price / lag(price) OVER ({ORD})) AS ret FROM swaps), v AS (SELECT tx, log_index, greatest(coalesce(sqrt(avg(ret * ret) OVER ({ORD} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), 0), fee, 0.01) AS s FROM x) SELECT tx, log_index, round(s, 6) AS sigma, CASE WHEN s < 0.4 THEN 'calm' WHEN s < 0.6 THEN 'normal' ELSE 'hot' END AS state FROM v")
def win_34_volatility_state(spark, d):
    x = swaps(spark, d).withColumn("ret", W.log_return(F.col("price"), _event()))
    rms = F.sqrt(F.avg(F.col("ret") * F.col("ret")).over(W.rows(_event(), -29, 0)))
    sigma = F.greatest(F.coalesce(rms, F.lit(0.0)), F.col("fee"), F.lit(0.01))
    return x.select(*ID, r(sigma, "sigma"), S.three_way(sigma, 0.4, 0.6, ("calm", "normal", "hot")).alias("state"))


@query(f"{SW}, x AS (SELECT tx, log_index, list(price) OVER ({ORD} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS p FROM swaps) SELECT tx, log_index, list_min(p) AS swing_low, list_max(p) AS swing_high, CAST(list_position(p, list_min(p)) - 1 AS BIGINT) AS low_at, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS high_at FROM x")
def win_35_swing(spark, d):
    """Low and high of the 60 rows before, and how many rows into them."""
    past = F.collect_list("price").over(W.rows(_event(), -60, -1))
    x = swaps(spark, d).select(*ID, past.alias("p")).withColumns({"swing_low": F.array_min("p"), "swing_high": F.array_max("p")})
    at = lambda c: (F.array_position("p", F.col(c)) - 1).cast("long")
    return x.select(*ID, "swing_low", "swing_high", at("swing_low").alias("low_at"), at("swing_high").alias("high_at"))


@query(f"""{SW} SELECT tx, log_index, coalesce(price > max(price) OVER f * 1.001, false) AS breakout_up, coalesce(price < min(price) OVER f * 0.999, false) AS breakout_down, coalesce((max(price) OVER f - min(price) OVER f) / price < 0.5, false) AS compressed, coalesce((max(price) OVER f - min(price) OVER f) / max(price) OVER f > 0.02 AND (price - min(price) OVER f) / NULLIF(max(price) OVER f - min(price) OVER f, 0) > 0.6, false) AS recovering FROM swaps WINDOW f AS ({ORD} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")
def win_36_breakout(spark, d):
    f, p, no = W.rows(_event(), -60, -1), F.col("price"), F.lit(False)
    hi, lo = F.max("price").over(f), F.min("price").over(f)
    back = (S.safe_div(hi - lo, hi) > 0.02) & (S.safe_div(p - lo, hi - lo) > 0.6)
    flags = {"breakout_up": p > hi * 1.001, "breakout_down": p < lo * 0.999, "compressed": S.safe_div(hi - lo, p) < 0.5, "recovering": back}
    return swaps(spark, d).select(*ID, *(F.coalesce(c, no).alias(n) for n, c in flags.items()))


@query(f"{SW}, k AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY price) + (count(*) OVER (PARTITION BY day, price) - 1) / 2.0 AS rk FROM swaps) SELECT tx, log_index, round(100.0 * rk / count(*) OVER (PARTITION BY day), 6) AS pct, CASE WHEN stddev_pop(price) OVER (PARTITION BY day) > 1e-9 THEN round((price - avg(price) OVER (PARTITION BY day)) / stddev_pop(price) OVER (PARTITION BY day), 5) END AS z FROM k")
def win_39_rank_percent(spark, d):
    w = Window.partitionBy("day")
    sd = F.stddev_pop("price").over(w)
    return swaps(spark, d).select(*ID, r(100 * FA.average_rank("price", ["day"]) / F.count(F.lit(1)).over(w), "pct"), F.when(sd > 1e-9, F.round((F.col("price") - F.avg("price").over(w)) / sd, 5)).alias("z"))


@query(f"{SW}, e AS (SELECT *, sum({SIGN} * quote) OVER ({ORD}) AS eq FROM swaps), p AS (SELECT *, greatest(max(eq) OVER ({ORD}), 0) AS pk FROM e) SELECT tx, log_index, pool, round(eq, 4) AS equity, round(pk, 4) AS peak, round(pk - eq, 4) AS drawdown, round(max(pk - eq) OVER ({ORD}), 4) AS max_drawdown FROM p")
def win_40_drawdown(spark, d):
    upto = _event().rowsBetween(Window.unboundedPreceding, 0)
    x = swaps(spark, d).withColumn("eq", F.sum(_side() * F.col("quote")).over(upto))
    x = x.withColumn("pk", F.greatest(F.max("eq").over(upto), F.lit(0.0))).withColumn("gap", F.col("pk") - F.col("eq"))
    return x.select(*ID, "pool", r("eq", "equity", 4), r("pk", "peak", 4), r("gap", "drawdown", 4), r(F.max("gap").over(upto), "max_drawdown", 4))


@query(f"""{_DAILY}, x AS (SELECT pool, dn, ln(vwap / lag(vwap) OVER ({_DW})) AS ret FROM daily), p AS (SELECT a.dn AS mk, x.pool AS i, y.pool AS j, count(*) AS n, corr(x.ret, y.ret) AS c FROM (SELECT DISTINCT dn FROM x WHERE pool < 10 AND ret IS NOT NULL) a JOIN x ON x.dn BETWEEN a.dn - 400 AND a.dn - 1 JOIN x y ON y.dn = x.dn AND y.pool > x.pool WHERE a.dn % 100 = 0 AND x.ret IS NOT NULL AND y.ret IS NOT NULL AND x.pool < 10 AND y.pool < 10 GROUP BY 1, 2, 3)
 SELECT mk AS dn, count(*) AS pairs, round(avg(c), 6) AS mean FROM p WHERE n >= 10 AND NOT isnan(c) GROUP BY 1""")
def win_11_pairwise_correlation(spark, d):
    """Mean correlation over the pairs of the ten first pools, the basket, in
    the 400 days before every hundredth day."""
    x = daily(spark, d).withColumn("ret", W.log_return(F.col("vwap"), _days())).filter("pool < 10 and ret is not null").select("pool", "dn", "ret")
    return ME.rolling_pair_correlation(x, "pool", "dn", "ret", 400, 10, 100).select("dn", "pairs", r("mean", "mean"))


@query(f"""{SW}, x AS (SELECT tx, log_index, day, pool, price FROM swaps), y AS (SELECT DISTINCT year(day) AS y FROM x), c AS (SELECT y, quantile_cont(price, 0.25) AS lo, quantile_cont(price, 0.75) AS hi, count(*) AS n FROM y JOIN x ON year(x.day) < y GROUP BY y), a AS (SELECT quantile_cont(price, 0.25) AS lo, quantile_cont(price, 0.75) AS hi FROM x)
 SELECT tx, log_index, CASE WHEN price <= CASE WHEN coalesce(c.n, 0) >= 50 THEN c.lo ELSE a.lo END THEN 0 WHEN price <= CASE WHEN coalesce(c.n, 0) >= 50 THEN c.hi ELSE a.hi END THEN 1 ELSE 2 END AS bucket FROM x LEFT JOIN c ON c.y = year(x.day), a""")
def win_24_prior_cuts(spark, d):
    """Edges from all rows of earlier years; the whole sample where those are
    fewer than 50."""
    x = swaps(spark, d).withColumn("y", F.year("day"))
    return ME.prior_cuts(x, "y", "price", [0.25, 0.75], 50).select(*ID, "bucket")


# -- labels ------------------------------------------------------------------


@query(f"{SW}, x AS (SELECT tx, log_index, price, list(price) OVER ({ORD} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS p FROM swaps) SELECT tx, log_index, round(list_max(p) / price - 1, 9) AS mfe, round(list_min(p) / price - 1, 9) AS mae, CAST(list_position(p, list_max(p)) AS BIGINT) AS to_peak, CAST(list_position(p, list_min(p)) AS BIGINT) AS to_trough FROM x")
def lbl_04_excursions(spark, d):
    x = swaps(spark, d).withColumn("p", P.ahead(F.col("price"), _event(), 10))
    at = lambda c: F.nullif(F.array_position("p", c), F.lit(0).cast("long"))
    hi, lo = F.array_max("p"), F.array_min("p")
    return x.select(*ID, r(hi / F.col("price") - 1, "mfe", 9), r(lo / F.col("price") - 1, "mae", 9), at(hi).alias("to_peak"), at(lo).alias("to_trough"))


def _first(cond):
    return f"list_position(list_transform(path, lambda p: {cond}), true)"


@query(f"""{SW}, x AS (SELECT *, list(price) OVER ({ORD} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS path FROM swaps), y AS (SELECT tx, log_index, len(path) AS m, ln(path[12] / price) * 1e4 AS ret, ln(list_max(path) / price) * 1e4 AS mfe, ln(list_min(path) / price) * 1e4 AS mae, {_first("ln(p / price) * 1e4 >= 500")} AS up, {_first("ln(p / price) * 1e4 <= -500")} AS dn FROM x)
 SELECT tx, log_index, CASE WHEN up IS NOT NULL AND up = dn THEN 'both_or_ambiguous' WHEN up IS NOT NULL AND (dn IS NULL OR up < dn) THEN 'up' WHEN dn IS NOT NULL THEN 'down' WHEN coalesce(m, 0) < 12 THEN 'future_missing' ELSE 'none' END AS label, round(ret, 4) AS ret, round(mfe, 4) AS mfe, round(mae, 4) AS mae FROM y""")
def lbl_08_triple_barrier(spark, d):
    move = lambda p: F.log(p / F.col("price")) * 1e4
    return ME.triple_barrier(swaps(spark, d).withColumn("path", P.ahead(F.col("price"), _event(), 12)), lambda p: move(p) >= 500, lambda p: move(p) <= -500, 12).select(*ID, "label", r(move(F.get("path", F.lit(11))), "ret", 4), r(move(F.array_max("path")), "mfe", 4), r(move(F.array_min("path")), "mae", 4))


_BARS = f"{TK}, bars AS (SELECT symbol, ts_us // 21600000000 AS b, max(price) AS hi, min(price) AS lo, arg_max(price, (ts_us, event_id)) AS c FROM ticks GROUP BY 1, 2)"
_BW = "PARTITION BY symbol ORDER BY b"


def _bars(spark, d):
    at = F.struct("ts_us", "event_id")
    return ticks(spark, d).groupBy("symbol", M.bucket("ts_us", 21_600_000_000).alias("b")).agg(F.max("price").alias("hi"), F.min("price").alias("lo"), F.max_by("price", at).alias("c"))


def _bar():
    return Window.partitionBy("symbol").orderBy("b")


@query(f"""{_BARS}, x AS (SELECT *, list({{'hi': hi, 'lo': lo, 'c': c}}) OVER ({_BW} ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS path FROM bars), y AS (SELECT symbol, b, len(path) AS m, path[8].c / c - 1 AS ret, list_max([p.hi FOR p IN path]) / c - 1 AS mfe, list_min([p.lo FOR p IN path]) / c - 1 AS mae, {_first("p.hi >= c * 1.5")} AS up, {_first("p.lo <= c * 0.5")} AS dn FROM x)
 SELECT symbol, b, CASE WHEN up IS NOT NULL AND up = dn THEN 'both_or_ambiguous' WHEN up IS NOT NULL AND (dn IS NULL OR up < dn) THEN 'up' WHEN dn IS NOT NULL THEN 'down' WHEN coalesce(m, 0) < 8 THEN 'future_missing' ELSE 'none' END AS label, round(ret, 6) AS ret, round(mfe, 6) AS mfe, round(mae, 6) AS mae FROM y""")
def lbl_09_high_low_barrier(spark, d):
    x = _bars(spark, d).withColumn("path", P.ahead(F.struct("hi", "lo", "c"), _bar(), 8))
    against = lambda v: S.quotient(v, F.col("c")) - 1
    return ME.triple_barrier(x, lambda p: p["hi"] >= F.col("c") * 1.5, lambda p: p["lo"] <= F.col("c") * 0.5, 8).select("symbol", "b", "label", r(against(F.get("path", F.lit(7))["c"]), "ret"), r(against(F.array_max("path.hi")), "mfe"), r(against(F.array_min("path.lo")), "mae"))


@query(f"""{SW}, v AS (SELECT *, {SIGN} AS sg, stddev_pop(ln(price / 1000)) OVER ({ORD} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sigma, list(price) OVER ({ORD} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS path FROM swaps), x AS (SELECT *, 2 * fee / 10 + 2 * 0.001 + 0.002 + 0.0005 + sigma * 0.1 AS bar FROM v), y AS (SELECT *, {_first("sg * ln(p / price) >= bar")} AS fav, {_first("sg * ln(p / price) <= -bar")} AS adv FROM x)
 SELECT tx, log_index, round(bar, 6) AS bar, CASE WHEN sg = 0 THEN 'missing_side' WHEN sigma IS NULL THEN 'missing_volatility' WHEN coalesce(len(path), 0) < 10 THEN 'missing_future' WHEN fav IS NULL AND adv IS NULL THEN 'dead_zone' WHEN fav IS NOT NULL AND (adv IS NULL OR fav < adv) THEN 'tradable' ELSE 'risk_first' END AS continuation, CASE WHEN sg = 0 THEN 'missing_side' WHEN sigma IS NULL THEN 'missing_volatility' WHEN coalesce(len(path), 0) < 10 THEN 'missing_future' WHEN fav IS NULL AND adv IS NULL THEN 'dead_zone' WHEN adv IS NOT NULL AND (fav IS NULL OR adv < fav) THEN 'tradable' ELSE 'risk_first' END AS reversal FROM y""")
def lbl_11_scaled_barrier(spark, d):
    sigma = F.stddev_pop(F.log(F.col("price") / 1000)).over(W.rows(_event(), -20, -1))
    x = swaps(spark, d).withColumns({"sg": _side(), "sigma": sigma, "path": P.ahead(F.col("price"), _event(), 10)})
    x = x.withColumn("bar", 2 * F.col("fee") / 10 + 2 * 0.001 + 0.002 + 0.0005 + F.col("sigma") * 0.1)
    return ME.scaled_barrier(x, "sg", "sigma", "bar", 10).select(*ID, r("bar", "bar"), "continuation", "reversal")


@query(f"""{SW}, x AS (SELECT *, {SIGN} AS sg, list(price) OVER ({ORD} ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS path FROM swaps), y AS (SELECT *, {_first("sg * (p / price - 1) >= 0.1")} AS fav, {_first("sg * (p / price - 1) <= -0.1")} AS adv FROM x WHERE sg <> 0 AND len(path) = 15)
 SELECT tx, log_index, CASE WHEN fav IS NOT NULL AND (adv IS NULL OR fav < adv) THEN 'favourable' WHEN adv IS NOT NULL THEN 'adverse' ELSE 'none' END AS label, round(sg * (path[15] / price - 1), 6) AS side_return, round((list_max(path) / price - 1) + (list_min(path) / price - 1), 6) AS asymmetry FROM y""")
def lbl_12_first_passage(spark, d):
    x = swaps(spark, d).withColumns({"sg": _side(), "path": P.ahead(F.col("price"), _event(), 15)}).filter("sg != 0 and size(path) = 15")
    p = F.col("price")
    move = lambda v: F.col("sg") * (v / p - 1)
    x = x.withColumns({"fav": P.first_hit(F.col("path"), lambda v: move(v) >= 0.1), "adv": P.first_hit(F.col("path"), lambda v: move(v) <= -0.1)})
    label = F.when(F.col("fav").isNotNull() & (F.col("adv").isNull() | (F.col("fav") < F.col("adv"))), "favourable").when(F.col("adv").isNotNull(), "adverse").otherwise("none")
    return x.select(*ID, label.alias("label"), r(move(F.element_at("path", 15)), "side_return"), r(F.array_max("path") / p + F.array_min("path") / p - 2, "asymmetry"))


@query(f"""{SW}, x AS (SELECT tx, log_index, {SIGN} AS sg, fee, lead(price, 5) OVER ({ORD}) / price - 1 AS ret FROM swaps) SELECT tx, log_index, slip, round(sg * ret - 2 * fee - 0.001 - 2 * slip, 6) AS net FROM x, (VALUES (0.0), (0.0005), (0.001)) v(slip)""")
def lbl_15_net_labels(spark, d):
    x = swaps(spark, d).withColumn("ret", S.safe_div(F.lead("price", 5).over(_event()), F.col("price")) - 1)
    x = x.withColumn("slip", F.explode(F.array(*map(F.lit, (0.0, 0.0005, 0.001)))))
    return x.select(*ID, "slip", r(_side() * F.col("ret") - 2 * F.col("fee") - 0.001 - 2 * F.col("slip"), "net"))


@query(f"""{SW}, x AS (SELECT tx, log_index, price * (1 - fee / 2) AS bid, price * (1 + fee / 2) AS ask, lead(price * (1 - fee / 2), 5) OVER w AS xb, lead(price * (1 + fee / 2), 5) OVER w AS xa FROM swaps WINDOW w AS ({ORD}))
 SELECT tx, log_index, round(1e4 * ln(xb / ask), 4) AS long_bps, round(1e4 * ln(bid / xa), 4) AS short_bps, round(1e4 * ln((xa + xb) / (ask + bid)), 4) AS mid_bps, round(1e4 * (ask - bid) / ((ask + bid) / 2), 4) AS spread_bps, round(1e4 * ln(ask / ((ask + bid) / 2)), 4) AS entry_cross_bps, round(1e4 * ln((xa + xb) / 2 / xb), 4) AS exit_cross_bps FROM x""")
def lbl_16_round_trip(spark, d):
    s = swaps(spark, d).withColumns({"bid": F.col("price") * (1 - F.col("fee") / 2), "ask": F.col("price") * (1 + F.col("fee") / 2)})
    s = s.withColumns({"xb": F.lead("bid", 5).over(_event()), "xa": F.lead("ask", 5).over(_event())})
    mid, exit_mid = (F.col("ask") + F.col("bid")) / 2, (F.col("xa") + F.col("xb")) / 2
    bps = lambda a, b, name: r(S.log_ratio(a, b, 1e4), name, 4)
    return s.select(*ID, bps(F.col("xb"), F.col("ask"), "long_bps"), bps(F.col("bid"), F.col("xa"), "short_bps"), bps(exit_mid, mid, "mid_bps"), r((F.col("ask") - F.col("bid")) / mid * 1e4, "spread_bps", 4), bps(F.col("ask"), mid, "entry_cross_bps"), bps(exit_mid, F.col("xb"), "exit_cross_bps"))


@query(f"""{_BARS}, x AS (SELECT *, list({{'hi': hi, 'lo': lo, 'c': c, 'gate': CAST(floor(c) AS BIGINT) % 5 <> 0, 'b': b}}) OVER ({_BW} ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS path FROM bars),
 y AS (SELECT *, {_first("p.hi >= c * 1.3")} AS tp, {_first("p.lo <= c * 0.7")} AS sl, list_position(list_transform(path, lambda p, i: i >= 3 AND NOT p.gate), true) AS off, list_position(list_transform(path, lambda p, i: p.b - b > i + 4), true) AS gap FROM x),
 z AS (SELECT *, least(coalesce(tp, 99), coalesce(sl, 99), coalesce(off, 99), coalesce(gap, 99), 8) AS k FROM y)
 SELECT symbol, b, CASE WHEN len(path) IS NULL THEN 'no_future' WHEN gap = k THEN 'data_gap' WHEN sl = k THEN 'stop' WHEN tp = k THEN 'target' WHEN off = k THEN 'gate_off' WHEN len(path) >= 8 THEN 'timeout' ELSE 'open' END AS reason, coalesce(tp = sl AND sl = k, false) AS tie, CASE WHEN len(path) IS NOT NULL THEN CAST(least(k, len(path)) AS BIGINT) END AS bars_held FROM z""")
def lbl_17_bar_exit(spark, d):
    x = _bars(spark, d).withColumn("gate", F.floor("c") % 5 != 0)
    x = x.withColumn("path", P.ahead(F.struct("hi", "lo", "c", "gate", "b"), _bar(), 8))
    return ME.bar_exit(x, 1.3, 0.7, 3, 4, 8).select("symbol", "b", "reason", "tie", "bars_held")


@query(f"""{_BARS}, x AS (SELECT *, list(c) OVER ({_BW} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS path FROM bars) SELECT symbol, b, CAST({_first("p <= c * 0.9")} AS BIGINT) AS pullback, CAST({_first("p >= c * 1.1")} AS BIGINT) AS breakout, CAST({_first("abs(p / c - 1) <= 0.05")} AS BIGINT) AS retest FROM x""")
def lbl_18_conditional_entry(spark, d):
    """Bars from a signal to the first that meets each rule, within six."""
    x, c = _bars(spark, d).withColumn("path", P.ahead(F.col("c"), _bar(), 6)), F.col("c")
    rules = {"pullback": lambda p: p <= c * 0.9, "breakout": lambda p: p >= c * 1.1, "retest": lambda p: F.abs(S.quotient(p, c) - 1) <= 0.05}
    return x.select("symbol", "b", *(P.first_hit(F.col("path"), f).cast("long").alias(n) for n, f in rules.items()))


# -- grids -------------------------------------------------------------------


@query(f"""{QT}, g AS (SELECT symbol, CAST(floor(ts_us / {DAY}) AS BIGINT) AS day, h FROM quotes, (SELECT unnest(range(1, 5)) AS h) GROUP BY ALL), e AS (SELECT symbol, day, day * {DAY} + h * {DAY // 4} AS tm FROM g)
 SELECT e.symbol, e.tm AS boundary, q.event_id FROM e ASOF JOIN quotes q ON q.symbol = e.symbol AND e.tm > q.ts_us WHERE q.ts_us >= e.day * {DAY}""")
def grd_07_boundary_state(spark, d):
    """At each quarter of a day, the latest quote that day of every symbol
    strictly before it."""
    return ME.boundary_state(quotes(spark, d), "symbol", "ts_us", "event_id", DAY, 4).select("symbol", F.col("at").alias("boundary"), "event_id")


@query(f"""{QT}, l AS (SELECT symbol, CAST(floor(ts_us / {DAY}) AS BIGINT) AS day, arg_max(event_id, (ts_us, event_id)) AS event_id, max(ts_us) AS ts_us FROM quotes GROUP BY 1, 2), f AS (SELECT symbol, CAST(floor(ts_us / {DAY}) AS BIGINT) AS day, min(ts_us) AS first FROM quotes GROUP BY 1, 2)
 SELECT l.symbol, l.day + 1 AS day, l.event_id FROM l LEFT JOIN f ON f.symbol = l.symbol AND f.day = l.day + 1 WHERE f.first IS NULL OR f.first > f.day * {DAY}""")
def grd_08_carry_in(spark, d):
    """Symbols without a quote at midnight, with the last of the day before."""
    q = quotes(spark, d).withColumn("day", M.bucket("ts_us", DAY))
    last = q.groupBy("symbol", "day").agg(F.max_by("event_id", F.struct("ts_us", "event_id")).alias("event_id")).withColumn("day", F.col("day") + 1)
    first = q.groupBy("symbol", "day").agg(F.min("ts_us").alias("first"))
    return last.join(first, ["symbol", "day"], "left").filter(F.col("first").isNull() | (F.col("first") > F.col("day") * DAY)).select("symbol", "day", "event_id")


@query(f"""{_DAILY}, l AS (SELECT pool, dn, dn - lag(dn) OVER ({_DW}) AS g FROM daily) SELECT pool, count(*) FILTER (g > 1) AS gaps, count(*) FILTER (g = 0) AS duplicates, count(*) FILTER (g <> 1) = 0 AS continuous FROM l GROUP BY pool""")
def grd_03_continuity(spark, d):
    """``assert_continuous`` raises where this says no."""
    return ME.continuity(daily(spark, d), ["pool"], "dn", 1)


# -- factors, controls, trade sets -------------------------------------------


@query(f"{SW}, p AS (SELECT pool, 1 AS k, CASE WHEN removed THEN price END AS a, CASE WHEN NOT removed THEN price END AS b FROM swaps), v AS (SELECT pool, price, count(*) FILTER (removed) AS na, count(*) FILTER (NOT removed) AS nb FROM swaps GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(nb) OVER (PARTITION BY pool ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v) SELECT pool, round(sum(na * (below + nb / 2.0)) / NULLIF(sum(na) * sum(nb), 0), 9) AS share FROM c GROUP BY pool")
def fac_25_high_over_low(spark, d):
    """Share of pairs in which a removed swap's price is above a kept one's,
    ties as halves, from counts of the different prices."""
    return ME.mann_whitney_share(swaps(spark, d), ["pool"], F.col("removed"), "price").select("pool", r("share", "share", 9))


@query(f"{SW}, x AS (SELECT day, base, quote, fee, price FROM swaps), m AS (SELECT corr(base, quote) AS bq, corr(base, fee) AS bf, corr(base, price) AS bp, corr(quote, fee) AS qf, corr(quote, price) AS qp, corr(fee, price) AS fp, count(*) AS n FROM x) SELECT a, b, n, round(c, 9) AS corr, abs(c) > 0.5 AS over_limit FROM m, LATERAL (VALUES ('base', 'quote', bq), ('base', 'fee', bf), ('base', 'price', bp), ('quote', 'fee', qf), ('quote', 'price', qp), ('fee', 'price', fp)) v(a, b, c)")
def fac_28_correlation_matrix(spark, d):
    return ME.correlation_pairs(swaps(spark, d), ["base", "quote", "fee", "price"], 0.5).select("a", "b", "n", r("corr", "corr", 9), "over_limit")


@query(f"""{SW}, x AS (SELECT pool, price, count(*) OVER (PARTITION BY pool) AS n, row_number() OVER (PARTITION BY pool ORDER BY price) - 1 AS i FROM swaps), u AS (SELECT pool, price, row_number() OVER (PARTITION BY pool ORDER BY price) - 1 AS j, count(*) OVER (PARTITION BY pool) AS m FROM (SELECT DISTINCT pool, price FROM swaps))
 SELECT l.pool, linear, nearest, at_distinct FROM (SELECT pool, round(quantile_cont(price, 0.9), 6) AS linear FROM swaps GROUP BY pool) l JOIN (SELECT pool, price AS nearest FROM x WHERE i = round((n - 1) * 0.9)) k USING (pool) JOIN (SELECT pool, price AS at_distinct FROM u WHERE j = floor(m * 0.9)) t USING (pool)""")
def fac_33_quantiles(spark, d):
    """Three conventions: linear, nearest rank, index among the different values."""
    return ME.quantile_conventions(swaps(spark, d), ["pool"], "price", 0.9).select("pool", r("linear", "linear"), "nearest", "at_distinct")


@query(f"""{SW}, x AS (SELECT pool, CASE WHEN direction = 'buy_base' THEN 1.0 ELSE 0.0 END AS y, 0.05 + 9 * fee AS p FROM swaps), t AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY p DESC, y DESC) AS i, count(*) OVER (PARTITION BY pool) AS n FROM x)
 SELECT pool, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(y) FILTER (i <= ceil(n / 10.0)) / NULLIF(avg(y), 0), 6) AS top_lift, round(corr(p, y), 6) AS ic FROM t GROUP BY pool""")
def fac_34_scoring(spark, d):
    x = swaps(spark, d).select("pool", (F.col("direction") == "buy_base").cast("double").alias("y"), (0.05 + 9 * F.col("fee")).alias("p"))
    return ME.scoring(x, ["pool"], "y", "p").select("pool", *(r(c, c) for c in ("log_loss", "brier", "top_lift", "ic")))


@query(f"""{SW}, e AS (SELECT date_trunc('month', ts) AS tm, 1 AS s, quote AS w FROM swaps UNION ALL SELECT date_trunc('month', ts) + INTERVAL 2 MONTH, -1, quote FROM swaps), d AS (SELECT tm, sum(CASE WHEN s > 0 THEN w ELSE 0 END) AS opened, sum(CASE WHEN s < 0 THEN w ELSE 0 END) AS closed FROM e GROUP BY tm), r AS (SELECT tm, sum(opened - closed) OVER (ORDER BY tm) AS open FROM d) SELECT round(max(open), 2) AS peak, round(quantile_cont(open, 0.95), 2) AS p95, count(*) AS steps FROM r""")
def pf_09_exposure_events(spark, d):
    """Positions open for two months; exits at an instant come before entries,
    so that the level after all of an instant's events counts."""
    month = F.date_trunc("month", "ts").cast("timestamp_ntz")
    legs = swaps(spark, d).select(month.alias("entry"), F.expr("date_trunc('month', cast(ts as timestamp_ntz)) + interval 2 month").alias("exit"), F.col("quote").alias("weight"))
    return ME.peak_exposure(legs, "entry", "exit", "weight").select(r("peak", "peak", 2), r("p95", "p95", 2), "steps")


@query(f"{SW}, d AS (SELECT day, pool, sum(quote) AS w FROM swaps GROUP BY 1, 2), p AS (SELECT day, sum(w) AS open FROM d GROUP BY 1), s AS (SELECT least(1, 200000 / max(open)) AS k FROM p) SELECT day, pool, round(w * k, 4) AS scaled FROM d, s")
def pf_11_scale_to_cap(spark, d):
    x = swaps(spark, d).groupBy("day", "pool").agg(F.sum("quote").alias("w"))
    return ME.scaled_to_cap(x, ["day"], "w", 200_000.0).select("day", "pool", r("scaled", "scaled", 4))


@query(f"""{SW}, x AS (SELECT pool, direction, count(*) AS n, avg(price) AS payoff FROM swaps WHERE day < DATE '1997-01-01' GROUP BY 1, 2), y AS (SELECT pool, year(day) AS y, direction, count(*) AS n, avg(price) AS payoff FROM swaps WHERE day >= DATE '1997-01-01' GROUP BY 1, 2, 3), b AS (SELECT pool, sum(n * payoff) / sum(n) AS mean FROM x GROUP BY 1)
 SELECT y.pool, y, round(sum(y.n * b.mean), 2) AS exposure, round(sum(y.n * (coalesce(x.payoff, b.mean) - b.mean)), 2) AS composition, round(sum(y.n * (y.payoff - coalesce(x.payoff, b.mean))), 2) AS payoff, arg_min(y.direction, (y.n * (y.payoff - coalesce(x.payoff, b.mean)), y.direction)) AS worst FROM y JOIN b USING (pool) LEFT JOIN x ON x.pool = y.pool AND x.direction = y.direction GROUP BY 1, 2""")
def pf_18_attribution(spark, d):
    """A year's total against the years before 1997: more rows at the baseline's
    mean, another mix of cells, and other payoffs in the cells."""
    s = swaps(spark, d).withColumn("y", F.year("day"))
    return ME.attribution(s.filter("day < date'1997-01-01'"), s.filter("day >= date'1997-01-01'"), "pool", "y", "direction", "price").select("pool", "y", *(r(c, c, 2) for c in ("exposure", "composition", "payoff")), "worst")


@query("SELECT o_custkey, o_orderkey, round(greatest(0, least(o_totalprice, 500000 - coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))), 2) AS fill FROM orders")
def pf_10_capacity_clip(spark, d):
    """In order, until a customer's capacity is used up."""
    return ME.capacity_clip(scan(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 500_000.0).select("o_custkey", "o_orderkey", r("fill", "fill", 2))
