"""Queries of books, minute states, quality and selection, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import book as B
from tickloom.operators import clean as C
from tickloom.operators import joins as J
from tickloom.operators import minute as M
from tickloom.operators import select as X
from tickloom.plans.market import KEY, SW, TK, query, r
from tickloom.sources.tables import BOOKS_SQL, QUOTES_SQL, TRADES_SQL, books, quotes, scan, swaps, ticks, trades

QT, TR, BO = f"WITH {QUOTES_SQL}", f"WITH {TRADES_SQL}", f"WITH {BOOKS_SQL}"
SIGN = "CASE direction WHEN 'buy_base' THEN 1 WHEN 'sell_base' THEN -1 ELSE 0 END"
MIN = 60_000_000


def rounded(df, keys, digits=6):
    """All columns but the keys rounded where they are numbers with a point."""
    return df.select(*keys, *(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys))


# -- minute states -----------------------------------------------------------


@query(f"""{QT}, q AS (SELECT *, (bid + ask) / 2 AS mid, bid * bid_size + ask * ask_size AS top, (bid * ask_size + ask * bid_size) / (bid_size + ask_size) AS micro FROM quotes)
 SELECT symbol, CAST(floor(ts_us / {MIN}) AS BIGINT) AS minute, round(arg_min(mid, (ts_us, event_id)), 9) AS open, round(max(mid), 9) AS high, round(min(mid), 9) AS low, round(arg_max(mid, (ts_us, event_id)), 9) AS close, round(arg_max(bid, (ts_us, event_id)), 9) AS bid, round(arg_max(ask, (ts_us, event_id)), 9) AS ask,
 round(median((ask - bid) / mid * 1e4), 9) AS spread_median, round(arg_max((ask - bid) / mid * 1e4, (ts_us, event_id)), 9) AS spread_last, round(median(top), 9) AS top_median, round(avg((micro - mid) / mid * 1e4), 9) AS micro_bps, count(*) AS n FROM q GROUP BY 1, 2""")
def agg_09_minute_book(spark, d):
    q = quotes(spark, d).withColumn("minute", M.bucket("ts_us", MIN))
    return rounded(M.book_ticker_state(q, ["symbol", "minute"], ["ts_us", "event_id"]), ["symbol", "minute"], 9)


def _notional(n):
    return f"list_sum([(base - 0.5 * i) * bq[i] FOR i IN range(1, {n + 1})])", f"list_sum([(base + 0.5 * i) * aq[i] FOR i IN range(1, {n + 1})])"


@query(f"""{BO}, x AS (SELECT symbol, ts_us // {MIN} AS minute, {_notional(5)[0]} AS b5, {_notional(5)[1]} AS a5, {_notional(25)[0]} AS b25, {_notional(25)[1]} AS a25, (((base - 0.5) * aq[1] + (base + 0.5) * bq[1]) / (bq[1] + aq[1]) - base) / base * 1e4 AS micro FROM books)
 SELECT symbol, minute, round(avg(b5), 6) AS bid_5, round(avg(a5), 6) AS ask_5, round(sum(b5 - a5) / sum(b5 + a5), 6) AS imbalance_5, round(median(b5 + a5), 6) AS depth_5, round(avg(b25), 6) AS bid_25, round(avg(a25), 6) AS ask_25, round(sum(b25 - a25) / sum(b25 + a25), 6) AS imbalance_25, round(median(b25 + a25), 6) AS depth_25, round(avg(micro), 6) AS micro_bps, count(*) AS n FROM x GROUP BY 1, 2""")
def agg_10_minute_depth(spark, d):
    b = books(spark, d).withColumn("minute", M.bucket("ts_us", MIN))
    return rounded(M.depth_state(b, ["symbol", "minute"]), ["symbol", "minute"])


@query(f"""{TR}, x AS (SELECT symbol, ts_us // {MIN} AS minute, count(*) AS n, sum(amount) AS amount, sum(price * amount) AS notional, sum(CASE WHEN side = 'buy' THEN amount ELSE 0 END) AS buy, sum(CASE WHEN side = 'sell' THEN amount ELSE 0 END) AS sell, sum(CASE WHEN side = 'unknown' THEN amount ELSE 0 END) AS unknown, arg_max(price, (ts_us, event_id)) AS last FROM trades GROUP BY 1, 2)
 SELECT symbol, minute, n, amount, round(notional, 6) AS notional, buy, sell, unknown, round(notional / amount, 6) AS vwap, last, round((buy - sell) / NULLIF(buy + sell, 0), 6) AS imbalance, round(buy / NULLIF(buy + sell, 0), 6) AS buy_share FROM x""")
def agg_11_minute_trades(spark, d):
    t = trades(spark, d).withColumn("minute", M.bucket("ts_us", MIN))
    return rounded(M.trade_state(t, ["symbol", "minute"], ["ts_us", "event_id"]), ["symbol", "minute"])


def _within(side, sign):
    return lambda s: f"coalesce(list_sum([(base {sign} 0.5 * i) * {side}[i] FOR i IN range(1, 26) IF 0.5 * i / base <= {s}]), 0)"


@query(f"""{BO}, x AS (SELECT vec_id, {_within("bq", "-")(0.01)} AS b1, {_within("bq", "-")(0.03)} AS b3, {_within("bq", "-")(0.05)} AS b5, {_within("aq", "+")(0.01)} AS a1, {_within("aq", "+")(0.03)} AS a3, {_within("aq", "+")(0.05)} AS a5 FROM books)
 SELECT vec_id, round(b1, 6) AS bid_1, round(b3, 6) AS bid_3, round(b5, 6) AS bid_5, round(a1, 6) AS ask_1, round(a3, 6) AS ask_3, round(a5, 6) AS ask_5, round((b5 - a5) / (b5 + a5), 6) AS imbalance, round((b5 - b1) / 0.04, 6) AS slope, round(CASE WHEN b5 > 0 AND a5 > 0 THEN ln(b5 / a5) END, 6) AS asymmetry FROM x""")
def agg_13_depth_distance(spark, d):
    b = books(spark, d)
    mid = (F.get("bids", F.lit(0))["price"] + F.get("asks", F.lit(0))["price"]) / 2
    # a hair beyond each share, so that a level at the share itself counts whatever the rounding
    shares = [s + 1e-9 for s in (0.01, 0.03, 0.05)]
    near = [list(M.depth_by_distance(F.col(side), mid, shares).values()) for side in ("bids", "asks")]
    x = b.select("vec_id", *(c.alias(f"{n}_{k}") for n, cs in zip(("bid", "ask"), near, strict=True) for k, c in zip((1, 3, 5), cs, strict=True)))
    return rounded(x.withColumns({"imbalance": B.imbalance(F.col("bid_5"), F.col("ask_5")), "slope": (F.col("bid_5") - F.col("bid_1")) / 0.04, "asymmetry": S.log_ratio(F.col("bid_5"), F.col("ask_5"))}), ["vec_id"])


@query(f"""{SW}, s AS (SELECT swaps.*, {SIGN} AS sg FROM swaps WHERE NOT removed) SELECT date_diff('minute', TIMESTAMP '1970-01-01', ts) AS minute, count(*) AS n, round(sum(base), 4) AS base, round(sum(quote), 4) AS quote, round(sum(quote) / NULLIF(sum(base), 0), 9) AS vwap FROM s GROUP BY 1""")
def agg_07_minute_vwap(spark, d):
    s = C.clean_reason(swaps(spark, d)).filter("not removed").withColumn("minute", F.expr("timestampdiff(MINUTE, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))"))
    return s.groupBy("minute").agg(F.count(F.lit(1)).alias("n"), r(F.sum("base"), "base", 4), r(F.sum("quote"), "quote", 4), r(S.safe_div(F.sum("quote"), F.sum("base")), "vwap", 9))


_SUMS = """count(*) AS swaps, count(*) FILTER (sg = 1) AS buys, count(*) FILTER (sg = -1) AS sells, round(sum(CASE WHEN sg = 1 THEN quote ELSE 0 END), 4) AS buy_volume, round(sum(CASE WHEN sg = -1 THEN quote ELSE 0 END), 4) AS sell_volume,
 round(sum(CASE WHEN sg <> 0 THEN sg * quote ELSE 0 END), 4) AS net_flow, round(coalesce((count(*) FILTER (sg = 1) - count(*) FILTER (sg = -1)) / NULLIF(count(*) FILTER (sg <> 0), 0), 0), 6) AS count_imbalance, round(coalesce(sum(quote) / NULLIF(sum(base), 0), 0), 9) AS vwap"""


def _pools(spark, d):
    """Swaps with the keys of their pool: nation as venue, region as family,
    part size as fee tier of the quote token."""
    s = scan(spark, d, "supplier").select(F.col("s_suppkey").alias("pool"), F.col("s_nationkey").alias("dex"))
    n = scan(spark, d, "nation").select(F.col("n_nationkey").alias("dex"), F.col("n_regionkey").alias("family"))
    return swaps(spark, d).join(s, "pool").join(n, "dex").withColumns({"hour": F.expr("date_trunc('HOUR', cast(ts as timestamp_ntz))"), "sg": S.side_sign(F.col("direction")), "quote_token": F.col("token") % 3})


_POOLS = f"{SW}, s AS (SELECT swaps.*, s_nationkey AS dex, n_regionkey AS family, date_trunc('hour', ts) AS hour, {SIGN} AS sg, token % 3 AS quote_token FROM swaps JOIN supplier ON s_suppkey = pool JOIN nation ON n_nationkey = s_nationkey)"


@query(f"{_POOLS} SELECT hour, pool, dex, family, quote_token, count(DISTINCT tx) AS txs, {_SUMS} FROM s GROUP BY ALL")
def agg_01_pool_buckets(spark, d):
    """Distinct transactions come from counts by transaction first, so that no
    row is expanded for them."""
    keys = ["hour", "pool", "dex", "family", "quote_token"]
    s = _pools(spark, d)
    per_tx = s.groupBy(*keys, "tx").agg(*(F.sum(c).alias(c) for c in ("quote", "base")), F.count(F.lit(1)).alias("k"), F.count_if(F.col("sg") == 1).alias("b"), F.count_if(F.col("sg") == -1).alias("s"), *(F.sum(F.when(F.col("sg") == g, F.col("quote")).otherwise(0.0)).alias(n) for g, n in ((1, "bv"), (-1, "sv"))))
    b, e = F.sum("b"), F.sum("s")
    return per_tx.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("txs"), F.sum("k").alias("swaps"), b.alias("buys"), e.alias("sells"), r(F.sum("bv"), "buy_volume", 4), r(F.sum("sv"), "sell_volume", 4), r(F.sum("bv") - F.sum("sv"), "net_flow", 4),
        r(F.coalesce(S.safe_div(b - e, b + e), F.lit(0.0)), "count_imbalance"), r(F.coalesce(S.safe_div(F.sum("quote"), F.sum("base")), F.lit(0.0)), "vwap", 9),
    )


@query(f"""{_POOLS} SELECT hour, pool, {_SUMS}, round(avg(fee), 9) AS gas_mean, round(median(fee), 9) AS gas_median, count(DISTINCT tx) AS active_blocks, round(count(*) FILTER (o_orderstatus = 'F') / NULLIF(count(o_orderstatus), 0), 6) AS success_rate FROM s LEFT JOIN orders ON o_orderkey = tx AND o_orderstatus <> 'P' GROUP BY ALL""")
def agg_02_hourly_features(spark, d):
    known = scan(spark, d, "orders").filter("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("tx"), "o_orderstatus")
    s = _pools(spark, d).join(known, "tx", "left")
    ok = S.safe_div(F.count_if(F.col("o_orderstatus") == "F"), F.count("o_orderstatus"))
    out = s.groupBy("hour", "pool").agg(*M.swap_sums(F.col("sg")), F.avg("fee").alias("gas_mean"), F.median("fee").alias("gas_median"), F.count_distinct("tx").alias("active_blocks"), ok.alias("success_rate"))
    digits = {"buy_volume": 4, "sell_volume": 4, "net_flow": 4, "gas_mean": 9, "gas_median": 9, "vwap": 9}
    return out.select("hour", "pool", *(r(c, c, digits.get(c, 6)) if t == "double" else c for c, t in out.dtypes[2:]))


@query(f"""{_POOLS}, o AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P') SELECT pool, count(*) AS raw, count(*) FILTER (NOT removed) AS clean, count(*) FILTER (removed) AS excluded, count(DISTINCT tx) AS txs, count(DISTINCT day) AS blocks, count(*) FILTER (sg = 1) AS buys, count(*) FILTER (sg = -1) AS sells, round(sum(sg * quote), 4) AS net_flow,
 round(median(price), 9) AS median_price, min(ts) AS first_seen, max(ts) AS last_seen, round(count(*) FILTER (o_orderstatus = 'F') / NULLIF(count(o_orderstatus), 0), 6) AS success_rate, round(avg(fee), 9) AS gas_mean FROM s LEFT JOIN o ON o_orderkey = tx GROUP BY pool""")
def agg_03_pool_summary(spark, d):
    """Distinct counts and the median come from counts by key, each small, and
    meet the sums by pool."""
    known = scan(spark, d, "orders").filter("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("tx"), "o_orderstatus")
    s = _pools(spark, d).join(known, "tx", "left")
    sums = s.groupBy("pool").agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(~F.col("removed")).alias("clean"), F.count_if(F.col("removed")).alias("excluded"), F.count_if(F.col("sg") == 1).alias("buys"), F.count_if(F.col("sg") == -1).alias("sells"), r(F.sum(F.col("sg") * F.col("quote")), "net_flow", 4),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), r(S.safe_div(F.count_if(F.col("o_orderstatus") == "F"), F.count("o_orderstatus")), "success_rate"), r(F.avg("fee"), "gas_mean", 9),
    )
    distinct = lambda c, name: s.select("pool", c).distinct().groupBy("pool").agg(F.count(F.lit(1)).alias(name))
    median = X.grouped_median(s, ["pool"], "price").select("pool", r("median", "median_price", 9))
    return sums.join(distinct("tx", "txs"), "pool").join(distinct("day", "blocks"), "pool").join(median, "pool", "left")


@query(f"""{_POOLS}, c AS (SELECT * FROM s WHERE NOT removed), h AS (SELECT hour, count(*) AS events, count(DISTINCT tx) AS txs, count(DISTINCT pool) AS pools, count(DISTINCT dex) AS dexes, round(sum(quote), 4) AS volume, round(sum(sg * quote), 4) AS net_flow, round(avg(fee), 9) AS gas_mean, round(sum(sg * quote) / NULLIF(sum(quote), 0), 6) AS flow_ratio, round(ln(1 + sum(quote)), 6) AS log_volume FROM c GROUP BY hour),
 b AS (SELECT hour, max(n) AS max_same_block FROM (SELECT hour, tx, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY hour), p AS (SELECT hour, round(max(q) / sum(q), 9) AS top_share, round(sum(q * q) / (sum(q) * sum(q)), 9) AS hhi FROM (SELECT hour, pool, sum(quote) AS q FROM c GROUP BY 1, 2) GROUP BY hour)
 SELECT h.*, max_same_block, top_share, hhi FROM h JOIN b USING (hour) JOIN p USING (hour)""")
def agg_04_hourly_market(spark, d):
    c = _pools(spark, d).filter("not removed")
    volume = F.sum("quote")
    h = c.groupBy("hour").agg(F.count(F.lit(1)).alias("events"), r(volume, "volume", 4), r(F.sum(F.col("sg") * F.col("quote")), "net_flow", 4), r(F.avg("fee"), "gas_mean", 9), r(S.safe_div(F.sum(F.col("sg") * F.col("quote")), volume), "flow_ratio"), r(F.log1p(volume), "log_volume"))
    b = c.groupBy("hour", "tx").agg(F.count(F.lit(1)).alias("n")).groupBy("hour").agg(F.count(F.lit(1)).alias("txs"), F.max("n").alias("max_same_block"))
    p = c.groupBy("hour", "pool", "dex").agg(F.sum("quote").alias("q")).groupBy("hour").agg(F.count(F.lit(1)).alias("pools"), F.count_distinct("dex").alias("dexes"), r(S.safe_div(F.max("q"), F.sum("q")), "top_share", 9), r(S.safe_div(F.sum(F.col("q") * F.col("q")), F.sum("q") * F.sum("q")), "hhi", 9))
    return h.join(b, "hour").join(p, "hour")


@query(f"{_POOLS}, x AS (SELECT CAST(pool AS VARCHAR) AS k, fee, sg FROM s UNION ALL SELECT 'all', fee, sg FROM s) SELECT k, count(*) AS n, count(*) FILTER (sg > 0) AS up, count(*) FILTER (sg < 0) AS down, round(avg(fee), 9) AS mean FROM x GROUP BY k")
def agg_17_with_total(spark, d):
    x = M.with_total(_pools(spark, d).withColumn("k", F.col("pool")), "k")
    return x.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sg") > 0).alias("up"), F.count_if(F.col("sg") < 0).alias("down"), r(F.avg("fee"), "mean", 9))


@query(f"""{TK}, x AS (SELECT symbol, ts_us // 3600000000 AS hour, ln(arg_max(price, (ts_us, event_id)) / arg_min(price, (ts_us, event_id))) AS ret FROM ticks GROUP BY 1, 2), w AS (SELECT c_custkey AS symbol, c_acctbal AS weight FROM customer WHERE c_acctbal > 5000)
 SELECT hour, round(sum(ret * weight) / NULLIF(sum(weight), 0), 9) AS weighted, round(avg(ret), 9) AS equal, count(*) AS symbols, round(coalesce(sum(ret * weight) / NULLIF(sum(weight), 0), avg(ret)), 9) AS basket FROM x LEFT JOIN w USING (symbol) WHERE ret IS NOT NULL GROUP BY hour""")
def agg_18_basket(spark, d):
    at = F.struct("ts_us", "event_id")
    x = ticks(spark, d).groupBy("symbol", M.bucket("ts_us", 3_600_000_000).alias("hour")).agg(S.natural_log(S.quotient(F.max_by("price", at), F.min_by("price", at))).alias("ret"))
    w = scan(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("symbol"), F.col("c_acctbal").alias("weight"))
    return rounded(M.basket_return(x, w, ["hour"], "symbol", "ret"), ["hour"], 9)


@query("SELECT o_custkey, '{' || string_agg('\"' || o_orderstatus || '\":' || n, ',' ORDER BY o_orderstatus) || '}' AS reasons FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def agg_23_reason_counts(spark, d):
    return X.counts_as_json(scan(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "reasons")


@query(f"""{_POOLS}, v AS (SELECT pool, count(*) AS n, round(sum(quote), 4) AS volume FROM s GROUP BY pool), h AS (SELECT hour, count(*) AS n, round(sum(quote), 4) AS volume FROM s GROUP BY hour)
 SELECT 'overview' AS part, 'all' AS k, count(*) AS n, round(sum(quote), 4) AS volume FROM s UNION ALL SELECT 'quote', CAST(quote_token AS VARCHAR), count(*), round(sum(quote), 4) FROM s GROUP BY quote_token
 UNION ALL SELECT * FROM (SELECT 'pool', CAST(pool AS VARCHAR), n, volume FROM v ORDER BY volume DESC, n DESC, pool LIMIT 5) UNION ALL SELECT * FROM (SELECT 'hour', strftime(hour, '%Y-%m-%d %H'), n, volume FROM h ORDER BY volume DESC, n DESC, hour LIMIT 5)
 UNION ALL SELECT 'price', CAST(quote_token AS VARCHAR), count(price), round(avg(price), 4) FROM s GROUP BY quote_token""")
def agg_24_basic_report(spark, d):
    s = _pools(spark, d)
    sums = [F.count(F.lit(1)).alias("n"), r(F.sum("quote"), "volume", 4)]
    part = lambda name, df, k: df.select(F.lit(name).alias("part"), k.cast("string").alias("k"), "n", "volume")
    top = lambda df, key: df.orderBy(F.desc("volume"), F.desc("n"), key).limit(5)
    return X.union_parts(
        part("overview", s.agg(*sums), F.lit("all")),
        part("quote", s.groupBy("quote_token").agg(*sums), F.col("quote_token")),
        part("pool", top(s.groupBy("pool").agg(*sums), "pool"), F.col("pool")),
        part("hour", top(s.groupBy("hour").agg(*sums), "hour"), F.date_format("hour", "yyyy-MM-dd HH")),
        part("price", s.groupBy("quote_token").agg(F.count("price").alias("n"), r(F.avg("price"), "volume", 4)), F.col("quote_token")),
    )


@query("""WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'pool' WHEN role = 'assistant' THEN 'token' ELSE 'other' END AS callee, length(text) % 17 = 0 AS reverted, turn AS depth FROM conversations), g AS (SELECT conv_id, count(*) FILTER (callee = 'pool') AS pools, count(*) FILTER (callee = 'token') AS tokens, count(*) FILTER (callee = 'other') AS others, count(*) FILTER (reverted) AS reverts, max(depth) AS depth FROM c GROUP BY conv_id)
 SELECT *, CASE WHEN pools + tokens + others = 0 THEN 'trace_failed' WHEN reverts > 0 THEN 'reverting' WHEN pools > 1 THEN 'multi_pool' WHEN pools = 1 THEN 'single_pool' ELSE 'non_pool' END AS path FROM g""")
def agg_26_call_tree(spark, d):
    """Turns of a conversation as calls of a transaction."""
    c = scan(spark, d, "conversations")
    callee = F.when(F.col("role") == "user", "pool").when(F.col("role") == "assistant", "token").otherwise("other")
    c = c.select("conv_id", callee.alias("callee"), F.coalesce(F.char_length("text") % 17 == 0, F.lit(False)).alias("reverted"), F.col("turn").alias("depth"))
    return X.call_tree(c, ["conv_id"])


@query(f"{BO}, x AS (SELECT vec_id, list_sum([bq[i] FOR i IN range(1, 26) IF i <= vec_id % 25]) AS l, list_sum([bq[i] FOR i IN range(1, 26) IF i > vec_id % 25 + 1]) AS rt, list_sum(bq) AS x, list_sum(aq) AS y FROM books) SELECT vec_id, round((coalesce(rt, 0) - coalesce(l, 0)) / NULLIF(coalesce(rt, 0) + coalesce(l, 0), 0), 6) AS ticks, round((y - x) / (y + x), 6) AS bins FROM x")
def agg_27_liquidity_imbalance(spark, d):
    """Around the active tick, a level's offset from it; and of two reserves."""
    b = books(spark, d)
    ticks_ = F.transform("bids", lambda x, i: F.struct((i - F.col("vec_id") % 25).alias("offset"), x["size"].alias("liquidity")))
    part = lambda keep: F.aggregate(F.filter(ticks_, keep), F.lit(0.0), lambda a, x: a + x["liquidity"])
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x["size"])
    return b.select("vec_id", r(B.imbalance(part(lambda x: x["offset"] > 0), part(lambda x: x["offset"] < 0)), "ticks"), r(B.imbalance(total("asks"), total("bids")), "bins"))


# -- books -------------------------------------------------------------------


def _size(c, n):
    return f"list_sum({c}[1:{n}])"


@query(f"""{BO}, x AS (SELECT *, {_size("bq", 5)} AS b5, {_size("aq", 5)} AS a5, {_size("bq", 25)} AS b25, {_size("aq", 25)} AS a25, {_size("bq", 3)} + {_size("aq", 3)} AS h FROM books)
 SELECT vec_id, round(base, 6) AS mid, round(1 / base * 1e4, 6) AS spread_bps, round(((base - 0.5) * aq[1] + (base + 0.5) * bq[1]) / (bq[1] + aq[1]), 6) AS micro, round(b5 + a5, 6) AS depth_5, round(b25 + a25, 6) AS depth_25, round((b5 - a5) / (b5 + a5), 6) AS imbalance_5, round((b25 - a25) / (b25 + a25), 6) AS imbalance_25, round(b5 / 2.5, 6) AS bid_slope, round(a5 / 2.5, 6) AS ask_slope, round((b5 + a5 - 2 * h) / (b5 + a5), 6) AS curvature, len(bq) AS bid_levels, round(bq[25], 6) AS last_bid_size FROM x""")
def bk_03_depth(spark, d):
    b = books(spark, d).withColumns(B.top_features())
    last = F.element_at("bids", -1)["size"]
    return rounded(b.withColumns({"bid_levels": F.size("bids").cast("long"), "last_bid_size": last}).drop("symbol", "ts_us", "bids", "asks"), ["vec_id"])


@query(f"""{BO}, x AS (SELECT vec_id, vec_id % 5 AS k, bq, aq FROM books) SELECT vec_id, 25 - k AS bids, 25 - k AS asks, 2 * k AS removed, round(bq[k + 1], 6) AS best_bid_size FROM x""")
def bk_02_uncrossed(spark, d):
    """Books whose asks were moved down by up to four levels and a half."""
    b = books(spark, d)
    down = F.transform("asks", lambda x: F.struct((x["price"] - (F.col("vec_id") % 5) * 1.0).alias("price"), x["size"].alias("size")))
    x = b.select("vec_id", B.uncrossed(F.col("bids"), down).alias("u"))
    return x.select("vec_id", F.size("u.bids").alias("bids"), F.size("u.asks").alias("asks"), F.col("u.removed").alias("removed"), r(F.get("u.bids", F.lit(0))["size"], "best_bid_size"))


@query(f"""{TK}, u AS (SELECT symbol, kind, ts_us, event_id, CASE WHEN event_id % 13 = 0 THEN 0 ELSE price END AS size, event_id % 20 < 3 AS snap FROM ticks), l AS (SELECT *, coalesce(lag(snap) OVER w, false) AS before FROM u WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, event_id)),
 g AS (SELECT *, count(*) FILTER (snap AND NOT before) OVER (PARTITION BY symbol ORDER BY ts_us, event_id) AS run FROM l), m AS (SELECT *, max(run) OVER (PARTITION BY symbol) AS newest FROM g) SELECT symbol, kind, arg_max(size, (ts_us, event_id)) AS size FROM m WHERE run = newest AND run > 0 GROUP BY 1, 2 HAVING arg_max(size, (ts_us, event_id)) > 0""")
def bk_01_state_at(spark, d):
    size, snap = F.when(F.col("event_id") % 13 == 0, 0.0).otherwise(F.col("price")), F.col("event_id") % 20 < 3
    u = ticks(spark, d).select("symbol", "kind", "ts_us", "event_id", size.alias("size"), snap.alias("snap"))
    return B.reset_state(u, ["symbol"], "kind", ["ts_us", "event_id"], "snap", "size").select("symbol", "kind", "size")


def _flow(sign, p, q):
    better, worse = (">", "<") if sign > 0 else ("<", ">")
    return f"{sign} * (CASE WHEN {p} {better} lag({p}) OVER w THEN {q} WHEN {p} {worse} lag({p}) OVER w THEN -lag({q}) OVER w ELSE {q} - lag({q}) OVER w END)"


@query(f"{QT} SELECT event_id, round({_flow(1, 'bid', 'bid_size')} + {_flow(-1, 'ask', 'ask_size')}, 6) AS by_case, round((CASE WHEN bid >= lag(bid) OVER w THEN bid_size ELSE 0 END) - (CASE WHEN bid <= lag(bid) OVER w THEN lag(bid_size) OVER w ELSE 0 END) - (CASE WHEN ask <= lag(ask) OVER w THEN ask_size ELSE 0 END) + (CASE WHEN ask >= lag(ask) OVER w THEN lag(ask_size) OVER w ELSE 0 END), 6) AS by_indicator FROM quotes WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, event_id)")
def bk_06_top_flow(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts_us", "event_id")
    args = (w, "bid", "bid_size", "ask", "ask_size")
    first = F.row_number().over(w) > 1
    indicator = F.when(first, B.indicator_imbalance(*args)).otherwise(0.0)
    return quotes(spark, d).select("event_id", r(B.order_flow_imbalance(*args), "by_case"), r(indicator, "by_indicator"))


def _level_sql(n):
    b, a = f"(base - 0.5 * {n})", f"(base + 0.5 * {n})"
    before = lambda x: f"lag({x}) OVER w"
    bid = f"(CASE WHEN {b} > {before(b)} THEN bq[{n}] WHEN {b} < {before(b)} THEN -{before(f'bq[{n}]')} ELSE bq[{n}] - {before(f'bq[{n}]')} END)"
    ask = f"(CASE WHEN {a} < {before(a)} THEN aq[{n}] WHEN {a} > {before(a)} THEN -{before(f'aq[{n}]')} ELSE aq[{n}] - {before(f'aq[{n}]')} END)"
    depth = f"greatest(bq[{n}] + aq[{n}], {before(f'bq[{n}]')} + {before(f'aq[{n}]')})"
    return f"{bid} - {ask} AS f{n}, ({bid} - {ask}) / {depth} AS g{n}"


_LEVELS = (1, 2, 3, 5, 10, 25)


@query(f"{BO}, x AS (SELECT vec_id, symbol, {', '.join(map(_level_sql, _LEVELS))} FROM books WINDOW w AS (PARTITION BY symbol ORDER BY vec_id)) SELECT vec_id, {', '.join(f'round(f{n}, 6) AS flow_{n}, round(g{n}, 6) AS share_{n}, round(avg(g{n}) OVER v, 6) AS mean_{n}' for n in _LEVELS)} FROM x WINDOW v AS (PARTITION BY symbol ORDER BY vec_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def bk_07_level_flows(spark, d):
    w = Window.partitionBy("symbol").orderBy("vec_id")
    flows = {n: B.level_flows(w, n) for n in _LEVELS}
    x = books(spark, d).select("vec_id", "symbol", *(c.alias(f"{k}_{n}") for n, f in flows.items() for k, c in zip(("flow", "share"), f, strict=True)))
    x = x.withColumns({f"mean_{n}": F.avg(f"share_{n}").over(w.rowsBetween(-9, 0)) for n in _LEVELS})
    return rounded(x.drop("symbol"), ["vec_id"])


@query(f"{TR} SELECT event_id, count(*) OVER f AS n, coalesce(sum(CASE WHEN side = 'buy' THEN amount ELSE 0 END) OVER f, 0) AS buy, coalesce(sum(CASE WHEN side = 'sell' THEN amount ELSE 0 END) OVER f, 0) AS sell, round(coalesce(sum(price * amount) OVER f, 0), 6) AS notional FROM trades WINDOW f AS (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)")
def bk_08_trade_window(spark, d):
    """Trades in (t − 1 day, t]."""
    f = Window.partitionBy("symbol").orderBy("ts_us").rangeBetween(-86_399_999_999, 0)
    of = lambda s: F.sum(F.when(F.col("side") == s, F.col("amount")).otherwise(0.0)).over(f)
    return trades(spark, d).select("event_id", F.count(F.lit(1)).over(f).alias("n"), of("buy").alias("buy"), of("sell").alias("sell"), r(F.sum(F.col("price") * F.col("amount")).over(f), "notional"))


@query(f"{BO}, x AS (SELECT vec_id, symbol, {_size('bq', 5)} + {_size('aq', 5)} AS depth, bq[1] AS b FROM books), y AS (SELECT *, lag(depth) OVER w AS p, lag(b) OVER w AS pb FROM x WINDOW w AS (PARTITION BY symbol ORDER BY vec_id)) SELECT vec_id, CASE WHEN pb IS NOT NULL THEN round(greatest(pb - b, 0) / greatest(depth, p), 6) END AS depletion, CASE WHEN pb IS NOT NULL THEN round(greatest(b - pb, 0) / greatest(depth, p), 6) END AS replenish, round((p - depth) / NULLIF(p, 0), 6) AS shock FROM y")
def bk_09_intensity(spark, d):
    w = Window.partitionBy("symbol").orderBy("vec_id")
    f = B.top_features()
    x = books(spark, d).select("vec_id", "symbol", f["depth_5"].alias("depth"), F.get("bids", F.lit(0))["size"].alias("b"))
    p, pb = F.lag("depth").over(w), F.lag("b").over(w)
    most = F.greatest("depth", p)
    ratio = lambda c: F.when(pb.isNotNull(), S.safe_div(F.greatest(c, F.lit(0.0)), most))
    return x.select("vec_id", r(ratio(pb - F.col("b")), "depletion"), r(ratio(F.col("b") - pb), "replenish"), r(S.safe_div(p - F.col("depth"), p), "shock"))


@query(f"""{BO}, x AS (SELECT vec_id, symbol, ts_us, base, {_size("bq", 5)} AS b, {_size("aq", 5)} AS a, ((base - 0.5) * aq[1] + (base + 0.5) * bq[1]) / (bq[1] + aq[1]) AS micro FROM books)
 SELECT x.vec_id, round((x.b - y.b) - (x.a - y.a), 6) AS flow, CASE WHEN y.b IS NOT NULL THEN round(greatest(y.b - x.b, 0) + greatest(y.a - x.a, 0), 6) END AS withdrawal, CASE WHEN y.b IS NOT NULL THEN round(greatest(x.b - y.b, 0) + greatest(x.a - y.a, 0), 6) END AS replenish, round(1e4 / x.base - 1e4 / y.base, 6) AS spread_drift, round((x.micro - y.micro) / y.micro * 1e4, 6) AS micro_drift, sign((x.b - y.b) - (x.a - y.a)) = sign(x.micro - y.micro) AS aligned
 FROM x ASOF LEFT JOIN x y ON x.symbol = y.symbol AND x.ts_us - 60000000 >= y.ts_us""")
def bk_10_dynamic_depth(spark, d):
    """Against the book as of 60 seconds before."""
    f = B.top_features()
    side = lambda c: F.aggregate(F.slice(c, 1, 5), F.lit(0.0), lambda s, x: s + x["size"])
    x = books(spark, d).select("vec_id", "symbol", "ts_us", f["mid"].alias("mid"), f["micro"].alias("micro"), side("bids").alias("b"), side("asks").alias("a"), f["spread_bps"].alias("s"))
    before = x.select("symbol", "ts_us", *(F.col(c).alias(f"p{c}") for c in ("micro", "b", "a", "s")))
    j = J.asof_join(x.withColumn("ts_us", F.col("ts_us") - 60_000_000), before, "ts_us", ["symbol"], ["pmicro", "pb", "pa", "ps"])
    db, da = F.col("b") - F.col("pb"), F.col("a") - F.col("pa")
    up = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    drift = F.col("micro") - F.col("pmicro")
    return j.select("vec_id", r(db - da, "flow"), r(up(-db) + up(-da), "withdrawal"), r(up(db) + up(da), "replenish"), r(F.col("s") - F.col("ps"), "spread_drift"), r(S.safe_div(drift, F.col("pmicro")) * 1e4, "micro_drift"), (F.signum(db - da) == F.signum(drift)).alias("aligned"))


@query(f"""{BO}, x AS (SELECT vec_id, list_transform(aq, lambda z, i: (0.2 + 0.03 * i) * least(z, greatest(0, 1.0 - (list_sum(aq[1:i]) - z)))) AS c, list_transform(aq, lambda z, i: 0.02 * (0.2 + 0.03 * i) * (0.8 - 0.03 * i) * least(z, greatest(0, 1.0 - (list_sum(aq[1:i]) - z)))) AS f, list_sum(aq) AS t FROM books)
 SELECT vec_id, round(CASE WHEN t >= 1.0 THEN list_sum(c) END, 6) AS cost, round(CASE WHEN t >= 1.0 THEN list_sum(f) END, 6) AS fee FROM x""")
def bk_12_shares_cost(spark, d):
    """One share down asks priced 0.23, 0.26, …"""
    asks = F.transform("asks", lambda x, i: F.struct((0.2 + 0.03 * (i + 1)).alias("price"), x["size"].alias("size")))
    c = B.shares_cost(asks, F.lit(1.0), 0.02)
    return books(spark, d).select("vec_id", c.alias("c")).select("vec_id", r("c.cost", "cost"), r("c.fee", "fee"))


@query(f"""{BO}, w AS (SELECT *, [(base - 0.5 * i) * bq[i] FOR i IN range(1, 26)] AS bn, [(base + 0.5 * i) * aq[i] FOR i IN range(1, 26)] AS an FROM books),
 x AS (SELECT *, list_transform(bn, lambda z, i: least(z, greatest(0, 50 - (list_sum(bn[1:i]) - z))) / (base - 0.5 * i)) AS bs, list_transform(an, lambda z, i: least(z, greatest(0, 50 - (list_sum(an[1:i]) - z))) / (base + 0.5 * i)) AS asz FROM w)
 SELECT vec_id, round((bq[1] - aq[1]) / (bq[1] + aq[1]), 6) AS obi_1, round(({_size("bq", 5)} - {_size("aq", 5)}) / ({_size("bq", 5)} + {_size("aq", 5)}), 6) AS obi_5, round(({_size("bq", 25)} - {_size("aq", 25)}) / ({_size("bq", 25)} + {_size("aq", 25)}), 6) AS obi_25, round((((base - 0.5) * aq[1] + (base + 0.5) * bq[1]) / (bq[1] + aq[1]) - base) / base * 1e4, 6) AS micro_bps,
 round(({_size("bq", 5)} + {_size("aq", 5)}) / ({_size("bq", 25)} + {_size("aq", 25)}), 6) AS near_share, round(CASE WHEN list_sum(bn) >= 50 AND list_sum(an) >= 50 THEN (50 / list_sum(asz) - 50 / list_sum(bs)) / base * 1e4 END, 6) AS round_trip_bps FROM x""")
def bk_13_snapshot_shape(spark, d):
    f5, f1 = B.top_features(), B.top_features(1, 25)
    mid = f5["mid"]
    trip = (B.walk_cost(F.col("asks"), 50.0) - B.walk_cost(F.col("bids"), 50.0)) / mid * 1e4
    return books(spark, d).select("vec_id", r(f1["imbalance_1"], "obi_1"), r(f5["imbalance_5"], "obi_5"), r(f5["imbalance_25"], "obi_25"), r((f5["micro"] - mid) / mid * 1e4, "micro_bps"), r(S.safe_div(f5["depth_5"], f5["depth_25"]), "near_share"), r(trip, "round_trip_bps"))


@query(f"""{BO}, n AS (SELECT vec_id, symbol, [(base - 0.5 * i) * bq[i] FOR i IN range(1, 26)] AS bn, base FROM books), x AS (SELECT *, list_transform(bn, lambda z, i: least(z, greatest(0, 50 - (list_sum(bn[1:i]) - z))) / (base - 0.5 * i)) AS s FROM n) SELECT vec_id, round(CASE WHEN list_sum(bn) >= 50 THEN 50 / list_sum(s) END, 6) AS cost FROM x""")
def bk_11_walk_cost(spark, d):
    return books(spark, d).select("vec_id", r(B.walk_cost(F.col("bids"), 50.0), "cost"))


@query(f"""{BO}, x AS (SELECT vec_id, symbol, list_max(bq) / list_avg(bq) AS ratio, list_position(bq, list_max(bq)) AS lv FROM books), y AS (SELECT *, list(lv) OVER (PARTITION BY symbol ORDER BY vec_id ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING) AS later FROM x) SELECT vec_id, round(ratio, 6) AS ratio, lv AS level, CAST(list_position(later, lv) AS BIGINT) AS seen_again FROM y WHERE ratio >= 2""")
def bk_14_walls(spark, d):
    """Largest level over the mean level, at least 2, and after how many of the
    next 30 books the same level is the largest again."""
    size = F.transform("bids", lambda x: x["size"])
    ratio = F.array_max(size) / (F.aggregate(size, F.lit(0.0), lambda a, x: a + x) / F.size(size))
    x = books(spark, d).select("vec_id", "symbol", ratio.alias("ratio"), F.array_position(size, F.array_max(size)).alias("level"))
    later = F.collect_list("level").over(Window.partitionBy("symbol").orderBy("vec_id").rowsBetween(1, 30))
    return x.withColumn("seen_again", F.nullif(F.array_position(later, F.col("level")), F.lit(0).cast("long"))).filter("ratio >= 2").select("vec_id", r("ratio", "ratio"), "level", "seen_again")
