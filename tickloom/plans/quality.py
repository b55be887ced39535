"""Queries of filters, validation, remaining joins and sorts, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import clean as C
from tickloom.operators import joins as J
from tickloom.operators import minute as M
from tickloom.operators import select as X
from tickloom.plans.market import KEY, SW, TK, query, r
from tickloom.plans.state import QT, SIGN, TR
from tickloom.sources.tables import quotes, scan, swaps, ticks, trades

DAY = 86_400_000_000

# -- filters -----------------------------------------------------------------


@query(f"{SW}, k AS (SELECT *, row_number() OVER (PARTITION BY pool, token ORDER BY ts DESC, tx DESC, log_index DESC) AS i, count(*) OVER (PARTITION BY pool, token) - 1 AS n_dropped FROM swaps) SELECT pool, token, tx, log_index, quote, n_dropped FROM k WHERE i = 1")
def flt_03_keep_latest(spark, d):
    x = swaps(spark, d).select("pool", "token", "tx", "log_index", "quote", "ts")
    return C.latest_and_dropped(x, ["pool", "token"], KEY).drop("ts")


_BLOCKS = "(SELECT min(o_orderdate) FROM orders WHERE o_orderstatus = 'F') AND (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F')"


@query(f"{SW} SELECT pool, count(*) FILTER (ts BETWEEN {_BLOCKS}) AS kept, count(*) FILTER (NOT ts BETWEEN {_BLOCKS}) AS removed FROM swaps GROUP BY pool")
def flt_05_rows_removed(spark, d):
    heads = scan(spark, d, "orders").filter("o_orderstatus = 'F'").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))  # one row
    inside = F.col("ts").between(F.col("lo"), F.col("hi"))
    return swaps(spark, d).join(F.broadcast(heads)).groupBy("pool").agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("removed"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate <= TIMESTAMP '1996-12-31' AND l_shipdate >= TIMESTAMP '1996-01-01'")
def flt_06_range_overlap(spark, d):
    """Lines whose [ordered, shipped] overlaps 1996."""
    o = scan(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1996-12-31"))
    return scan(spark, d, "lineitem").join(o, "l_orderkey").filter(C.overlaps(lo, hi, F.col("o_orderdate").cast("timestamp_ntz"), F.col("l_shipdate").cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber")


@query(f"{TK}, x AS (SELECT event_id, price, count(*) OVER w AS n, sum(price) OVER w AS v, (1 + event_id % 10) / 100.0 AS gas FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)) SELECT event_id, price >= 10 AND n >= 2 AND v >= 50 AND gas <= 0.05 AS is_tradable FROM x")
def flt_08_tradable(spark, d):
    x = ticks(spark, d).withColumn("gas", (1 + F.col("event_id") % 10) / 100.0)
    return C.tradable(x, ["symbol"], "ts_us", "price", "gas", DAY, 10, 2, 50, 0.05).select("event_id", "is_tradable")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def flt_09_allow_list(spark, d):
    return scan(spark, d, "customer").filter(C.allowed(F.col("c_mktsegment"), ["Building", "MACHINERY"]) & C.allowed(F.col("c_name"), [])).select("c_custkey")


@query("SELECT o_orderkey, CAST(list_sum([(strpos('0123456789abcdef', md5(CAST(o_custkey AS VARCHAR))[i:i]) - 1) * pow(16, 8 - i) FOR i IN range(1, 9)]) % 16 AS INTEGER) AS shard FROM orders")
def flt_11_hash_shard(spark, d):
    return scan(spark, d, "orders").select("o_orderkey", C.shard_of(F.col("o_custkey"), 16).alias("shard"))


@query(f"{QT} SELECT symbol, count(*) AS n, count(*) FILTER ((ask - bid) / ((ask + bid) / 2) * 1e4 > 25.001) AS wide FROM quotes GROUP BY symbol")
def flt_12_wide_spread(spark, d):
    return M.quote_columns(quotes(spark, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("spread_bps") > 25.001).alias("wide"))


# -- quality -----------------------------------------------------------------


@query(f"{SW} SELECT 'event' AS k, CAST(count(*) - count(DISTINCT (tx, log_index, pool)) AS BIGINT) AS duplicates FROM swaps UNION ALL SELECT 'tx', CAST(count(tx) - count(DISTINCT tx) AS BIGINT) FROM swaps UNION ALL SELECT 'block', CAST(count(ts) - count(DISTINCT ts) AS BIGINT) FROM swaps")
def qlt_01_duplicate_keys(spark, d):
    s = swaps(spark, d)
    one = lambda k, keys: C.duplicate_keys(s, keys).select(F.lit(k).alias("k"), "duplicates")
    return X.union_parts(one("event", ["tx", "log_index", "pool"]), one("tx", ["tx"]), one("block", ["ts"]))


@query("SELECT count(*) FILTER (event_id % 7 = 0) AS made_utc, count(*) FILTER (event_id % 11 = 0 AND event_id % 5 <> 0) AS seen_utc FROM events")
def qlt_02_timestamp_format(spark, d):
    """Times written as text, some of them without their Z or cut short."""
    text = F.date_format(F.expr("cast(ts as timestamp_ntz)"), "yyyy-MM-dd'T'HH:mm:ss")
    made = F.concat(text, F.when(F.col("event_id") % 7 == 0, "").otherwise("Z"))
    seen = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 11 == 0, F.concat(F.substring(text, 1, 8), F.lit("Z"))).otherwise(F.concat(text, F.lit("Z")))
    return C.bad_timestamps(scan(spark, d, "events").select(made.alias("made_utc"), seen.alias("seen_utc")), ["made_utc", "seen_utc"])


@query(f"{TK} SELECT count(*) AS n, count(*) FILTER (event_id % 9 = 0) AS wrong FROM ticks")
def qlt_03_partition_consistency(spark, d):
    """Rows whose day is not that of the partition they were put into."""
    t = ticks(spark, d).withColumn("dt", F.when(F.col("event_id") % 9 == 0, F.date_add("day", 1)).otherwise(F.col("day")))
    return C.wrong_partition(t, "dt", "day")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS receipt_errors, count(*) FILTER (o_orderstatus <> 'O') AS body_errors FROM orders")
def qlt_04_status_errors(spark, d):
    o = scan(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("receipt"), F.when(F.col("o_orderstatus") == "O", "ok").otherwise("late").alias("body"))
    return o.agg(F.count_if(F.col("receipt") == "error").alias("receipt_errors"), F.count_if(~F.col("body").eqNullSafe("ok")).alias("body_errors"))


@query("""SELECT 'swap_without_receipt' AS leg, l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 2
 UNION ALL SELECT 'pool_without_snapshot', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) UNION ALL SELECT 'pool_without_swap', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def qlt_06_missing_keys(spark, d):
    key = lambda df, c: df.select(F.col(c).alias("k"))
    li, su = scan(spark, d, "lineitem"), scan(spark, d, "supplier")
    legs = {
        "swap_without_receipt": (key(li, "l_orderkey"), key(scan(spark, d, "orders").filter("o_orderstatus != 'P'"), "o_orderkey")),
        "pool_without_snapshot": (key(su, "s_suppkey"), key(su.filter("s_acctbal > 0"), "s_suppkey")),
        "pool_without_swap": (key(scan(spark, d, "part"), "p_partkey"), key(li.filter("l_returnflag = 'A'"), "l_partkey")),
    }
    return X.union_parts(*(C.missing_keys(a, b, ["k"]).select(F.lit(n).alias("leg"), "k") for n, (a, b) in legs.items()))


@query(f"""{QT}, c AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN ask ELSE bid END AS b, CASE WHEN event_id % 17 = 0 THEN bid ELSE ask END AS a FROM quotes), l AS (SELECT *, lag(event_id) OVER w AS ps, lag(ts_us) OVER w AS pt FROM c WINDOW w AS (PARTITION BY symbol ORDER BY event_id))
 SELECT symbol, count(*) AS n, count(*) FILTER (event_id <> ps + 1) AS gaps, count(*) FILTER (ts_us < pt) AS regressions, count(*) FILTER (NOT (b > 0 AND a > 0)) AS bad_price, count(*) FILTER (NOT (bid_size > 0 AND ask_size > 0)) AS bad_size, count(*) FILTER (b >= a) AS crossed, count(*) FILTER (event_id % 50 = 0) AS snapshots, count(*) FILTER (event_id % 50 = 0) > 0 AND count(*) FILTER (event_id <> ps + 1) = 0 AS reconstructible FROM l GROUP BY symbol""")
def qlt_07_sequence_quality(spark, d):
    swap = F.col("event_id") % 17 == 0
    q = quotes(spark, d).select("symbol", "event_id", "ts_us", "bid_size", "ask_size", F.when(swap, F.col("ask")).otherwise(F.col("bid")).alias("bid"), F.when(swap, F.col("bid")).otherwise(F.col("ask")).alias("ask"), (F.col("event_id") % 50 == 0).alias("snapshot"))
    return C.quote_quality(q, "symbol", "event_id", "ts_us", "snapshot")


@query(f"""{SW}, x AS (SELECT *, {SIGN} AS sg, CASE WHEN log_index = 3 THEN 1 ELSE -1 END AS qs, price * (1 + (tx % 5) / 20000.0) AS stored FROM swaps) SELECT count(*) FILTER (sg <> 0 AND sg * base * (-sg * qs * -1) * quote > 0) AS same_sign, count(*) FILTER (tx % 13 = 0 AND sg <> 0) AS wrong_direction, count(*) FILTER (abs(price / stored - 1) * 1e4 > 1) AS price_gap, round(max(abs(price / stored - 1) * 1e4), 6) AS max_gap_bps FROM x""")
def qlt_08_invariants(spark, d):
    """Deltas of which some have one sign, some a direction that their base
    delta denies, and some a stored price off the implied one."""
    sign = S.side_sign(F.col("direction"))
    base = sign * F.col("base")
    quote = sign * F.when(F.col("log_index") == 3, F.col("quote")).otherwise(-F.col("quote"))
    told = F.when(F.col("tx") % 13 == 0, -sign).otherwise(sign)
    x = swaps(spark, d).select(base.alias("base"), quote.alias("quote"), told.alias("told"), F.col("price").alias("implied"), (F.col("price") * (1 + (F.col("tx") % 5) / 20000.0)).alias("stored"))
    return C.swap_invariants(x, 1.0).select("same_sign", "wrong_direction", "price_gap", r("max_gap_bps", "max_gap_bps"))


@query(f"""{QT}, q AS (SELECT *, ts_us // {DAY} AS dt, (bid + ask) / 2 AS mid FROM quotes), l AS (SELECT *, lag(mid) OVER w AS pm, lag(floor(bid)) OVER w AS pq, lag(ts_us) OVER w AS pt, lead(mid) OVER w / mid - 1 AS target FROM q WINDOW w AS (PARTITION BY dt ORDER BY ts_us, event_id)),
 f AS (SELECT *, CASE WHEN floor(bid) IS NOT DISTINCT FROM pq THEN 0 ELSE 1 END AS ch FROM l), g AS (SELECT *, sum(ch) OVER (PARTITION BY dt ORDER BY ts_us, event_id) AS run FROM f), u AS (SELECT dt, run, count(*) AS k, (max(ts_us) - min(ts_us)) / 1e6 AS sec FROM g GROUP BY 1, 2), v AS (SELECT dt, max(k) AS longest_rows, round(max(sec), 3) AS longest_seconds FROM u GROUP BY dt),
 a AS (SELECT dt, count(*) AS n, count(DISTINCT mid) AS mids, count(DISTINCT (bid, ask)) AS pairs, round(avg(CASE WHEN pm IS NULL THEN NULL WHEN mid <> pm THEN 1.0 ELSE 0.0 END), 6) AS change_rate, round(avg(CASE WHEN event_id % 5 < 2 THEN 1.0 ELSE 0.0 END), 6) AS trade_rate, round(quantile_cont((ts_us - pt) / 1e6, 0.5), 3) AS gap_p50, round(quantile_cont((ts_us - pt) / 1e6, 0.95), 3) AS gap_p95, count(target) AS target_rows, round(avg(CASE WHEN target IS NULL THEN NULL WHEN target <> 0 THEN 1.0 ELSE 0.0 END), 6) AS target_nonzero, round(quantile_cont(abs(target), 0.95), 6) AS target_p95 FROM f GROUP BY dt)
 SELECT a.*, longest_rows, longest_seconds FROM a JOIN v USING (dt)""")
def qlt_09_longest_unchanged(spark, d):
    q = M.quote_columns(quotes(spark, d)).withColumn("dt", M.bucket("ts_us", DAY)).withColumn("traded", F.col("event_id") % 5 < 2)
    w = Window.partitionBy("dt").orderBy("ts_us", "event_id")
    q = q.withColumns({"level": F.floor("bid"), "gap": (F.col("ts_us") - F.lag("ts_us").over(w)) / 1e6, "before": F.lag("mid").over(w), "target": S.quotient(F.lead("mid").over(w), F.col("mid")) - 1})
    rate = lambda c: F.avg(c.cast("int"))
    a = q.groupBy("dt").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("mid").alias("mids"), F.count_distinct("bid", "ask").alias("pairs"), r(rate(F.col("mid") != F.col("before")), "change_rate"), r(rate(F.col("traded")), "trade_rate"),
        r(F.percentile("gap", 0.5), "gap_p50", 3), r(F.percentile("gap", 0.95), "gap_p95", 3), F.count("target").alias("target_rows"), r(rate(F.col("target") != 0), "target_nonzero"), r(F.percentile(F.abs("target"), 0.95), "target_p95"),
    )
    return a.join(C.longest_run(q, ["dt"], ["ts_us", "event_id"], "level", "ts_us"), "dt")


@query(f"""{TK}, x AS (SELECT symbol, kind, min(ts_us) AS t FROM ticks GROUP BY 1, 2), p AS (SELECT symbol, min(t) FILTER (kind = 'view') AS i, min(t) FILTER (kind = 'click') AS s, min(t) FILTER (kind = 'signup') AS a, min(t) FILTER (kind = 'purchase') AS k, min(t) FILTER (kind = 'error') AS rj FROM x GROUP BY symbol)
 SELECT symbol, unnest(list_filter(['no_intent', 'no_scheduled', 'no_arrived', 'no_answer', 'out_of_order'], lambda v: CASE v WHEN 'no_intent' THEN i IS NULL WHEN 'no_scheduled' THEN s IS NULL WHEN 'no_arrived' THEN a IS NULL WHEN 'no_answer' THEN k IS NULL AND rj IS NULL ELSE coalesce(s < i, false) OR coalesce(a < s, false) OR coalesce(least(k, rj) < a, false) END)) AS violation FROM p""")
def qlt_11_chain_audit(spark, d):
    """A symbol's kinds as the steps of an order."""
    step = F.create_map(*(F.lit(x) for p in {"view": "intent", "click": "scheduled", "signup": "arrived", "purchase": "ack", "error": "reject"}.items() for x in p))
    log = ticks(spark, d).select("symbol", "ts_us", "price", F.get(F.array(step), F.lit(0))[F.col("kind")].alias("step"))
    return C.chain_audit(log, "symbol", "step", "ts_us", ["price"])


@query("WITH x AS (SELECT md5(CAST(o_custkey AS VARCHAR) || '|' || o_orderkey || '|' || o_orderpriority || '|' || o_orderstatus) AS h FROM orders), s AS (SELECT count(*) AS n, sum(list_sum([CAST(strpos('0123456789abcdef', h[i:i]) - 1 AS HUGEINT) * CAST(pow(16, 12 - i) AS HUGEINT) FOR i IN range(1, 13)])) AS t FROM x) SELECT n, sha256(CAST(CAST(t AS HUGEINT) AS VARCHAR)) AS hash FROM s")
def qlt_12_content_hash(spark, d):
    """Volatile columns are left out."""
    return C.content_hash(scan(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), 6)


@query("""SELECT o_orderkey, 'differs' AS status, 'o_totalprice' AS fields FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderkey % 10 <> 3 UNION ALL SELECT o_orderkey, 'right_missing', NULL FROM orders WHERE o_orderkey % 10 = 3""")
def qlt_13_compare_rows(spark, d):
    """A run against another that lost some rows and moved some prices, beyond
    and within the tolerance."""
    o = scan(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    moved = F.col("o_totalprice") + F.when(F.col("o_orderpriority").startswith("1"), 1.0).when(F.col("o_orderpriority").startswith("2"), 0.25).otherwise(0.0)
    b = o.filter("o_orderkey % 10 != 3").withColumn("o_totalprice", moved)
    return C.keyed_comparison(o, b, ["o_orderkey"], 0.5)


@query("""WITH a AS (SELECT o_orderdate, o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq FROM orders), b AS (SELECT o_orderdate, o_orderkey, o_totalprice + CASE WHEN o_custkey % 10 = 1 THEN 1 ELSE 0 END AS p, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')
 SELECT seq, CASE WHEN b.seq IS NULL THEN 'left_only' ELSE 'differs' END AS status, CASE WHEN b.seq IS NOT NULL THEN 'o_totalprice' END AS fields FROM a LEFT JOIN b USING (seq) WHERE b.seq IS NULL OR abs(o_totalprice - p) > 0.5""")
def qlt_13_compare_ordinal(spark, d):
    o = scan(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_totalprice", "o_custkey")
    b = o.filter("o_orderdate < timestamp_ntz'1998-01-01'").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_custkey") % 10 == 1, 1.0).otherwise(0.0))
    return C.ordinal_comparison(o.drop("o_custkey"), b.drop("o_custkey"), ["o_orderdate", "o_orderkey"], 0.5)


# -- joins -------------------------------------------------------------------


@query(f"""{TK}, s AS (SELECT symbol % 2 AS side, ts_us, event_id, price FROM ticks), a AS (SELECT * FROM s WHERE side = 0), b AS (SELECT ts_us, max(event_id) AS other FROM s WHERE side = 1 GROUP BY 1),
 x AS (SELECT a.*, b.other AS o1, a.ts_us - b.ts_us AS g1 FROM a ASOF LEFT JOIN b ON a.ts_us >= b.ts_us), y AS (SELECT x.*, b.other AS o2, b.ts_us - x.ts_us AS g2 FROM x ASOF LEFT JOIN b ON x.ts_us <= b.ts_us)
 SELECT event_id, CASE WHEN least(g1, g2) <= 600000000 THEN CASE WHEN g2 IS NOT NULL AND (g1 IS NULL OR g2 <= g1) THEN o2 ELSE o1 END END AS other FROM y""")
def joi_08_nearest_other(spark, d):
    """Nearest tick of another group of symbols, within ten minutes.  Both
    sides are cut into days, each with what lies within the tolerance of its
    ends, so that no task holds more than a day."""
    t = ticks(spark, d)
    cell = lambda us: F.floor(us / DAY)
    a = t.filter("symbol % 2 = 0").select("ts_us", "event_id", cell(F.col("ts_us")).alias("cell"))
    b = t.filter("symbol % 2 = 1").groupBy("ts_us").agg(F.max("event_id").alias("other"))
    reach = 600_000_000
    near = F.array_distinct(F.array(cell(F.col("ts_us") - reach), cell(F.col("ts_us")), cell(F.col("ts_us") + reach)))
    b = b.withColumn("cell", F.explode(near))
    j = J.nearest_join(a, b, "ts_us", ["cell"], "other")
    return j.select("event_id", F.when(F.col("age") <= reach, F.col("other")).alias("other"))


@query(f"{TK} SELECT x.event_id, min(y.ts_us) - x.ts_us AS wait_us FROM ticks x LEFT JOIN ticks y ON y.symbol = x.symbol AND y.ts_us >= x.ts_us + 3600000000 AND y.event_id <> x.event_id GROUP BY x.event_id, x.ts_us")
def joi_10_own_later_event(spark, d):
    """The symbol's first other event at least an hour later, by a forward as-of
    join: a frame to the end of the key would be evaluated anew for each row."""
    t = ticks(spark, d)
    asked = t.select("symbol", "event_id", (F.col("ts_us") + 3_600_000_000).alias("ts_us"))
    later = t.select("symbol", "ts_us", F.col("event_id").alias("other"))
    return J.asof_join(asked, later, "ts_us", ["symbol"], ["other"], forward=True).select("event_id", (F.col("age") + 3_600_000_000).alias("wait_us"))


@query("""WITH c AS (SELECT p_partkey AS id, p_brand AS underlying, p_type AS expiry, p_size AS strike, CASE WHEN p_partkey % 2 = 0 THEN 'above' ELSE 'below' END AS way FROM part), s AS (SELECT *, lead(id) OVER w AS nx, lead(strike) OVER w AS ns FROM c WINDOW w AS (PARTITION BY underlying, expiry, way ORDER BY strike, id))
 SELECT CASE WHEN way = 'above' THEN nx ELSE id END AS src, CASE WHEN way = 'above' THEN id ELSE nx END AS dst, CASE WHEN ns = strike THEN 'support' ELSE 'implication' END AS type FROM s WHERE nx IS NOT NULL""")
def joi_18_claim_edges(spark, d):
    """Claims of one underlying, expiry and direction, each with the next
    strike: above the higher implies above the lower, below the lower implies
    below the higher; equal strikes support each other.  Further implications
    follow along the chain, so the edges grow with the claims."""
    p = scan(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("underlying"), F.col("p_type").alias("expiry"), F.col("p_size").alias("strike"), F.when(F.col("p_partkey") % 2 == 0, "above").otherwise("below").alias("way"))
    w = Window.partitionBy("underlying", "expiry", "way").orderBy("strike", "id")
    x = p.withColumns({"nx": F.lead("id").over(w), "ns": F.lead("strike").over(w)}).filter("nx is not null")
    up = F.col("way") == "above"
    return x.select(F.when(up, F.col("nx")).otherwise(F.col("id")).alias("src"), F.when(up, F.col("id")).otherwise(F.col("nx")).alias("dst"), F.when(F.col("ns") == F.col("strike"), "support").otherwise("implication").alias("type"))


# -- sorts and selections ----------------------------------------------------


@query(f"{SW} SELECT tx, log_index, pool, row_number() OVER (ORDER BY day, ts, tx, log_index, pool) - 1 AS seq FROM swaps")
def srt_01_event_order(spark, d):
    return X.with_sequence(swaps(spark, d), "day", [*KEY, "pool"]).select("tx", "log_index", "pool", "seq")


@query(f"{SW} SELECT pool, round(corr(base, fee), 6) AS score FROM swaps GROUP BY pool ORDER BY abs(corr(base, fee)) DESC NULLS LAST, pool LIMIT 10")
def srt_02_top_report(spark, d):
    x = swaps(spark, d).groupBy("pool").agg(F.corr("base", "fee").alias("score"))
    return x.orderBy(F.abs("score").desc_nulls_last(), "pool").limit(10).select("pool", r("score", "score"))


@query(f"""{SW}, k AS (SELECT pool, token % 20 AS f, count(*) AS n, sum(quote) / count(*) AS score FROM swaps WHERE NOT removed GROUP BY 1, 2), c AS (SELECT pool, token % 20 AS f, log_index % 2 AS control, sum(quote) / count(*) AS score FROM swaps WHERE removed AND log_index % 7 < 5 GROUP BY 1, 2, 3), g AS (SELECT pool, f, count(DISTINCT control) AS kinds, max(score) AS best FROM c GROUP BY 1, 2)
 SELECT k.pool, k.f, n, round(k.score, 8) AS score FROM k JOIN g USING (pool, f) WHERE kinds >= 2 AND best < k.score""")
def srt_04_survivors(spark, d):
    s = swaps(spark, d).withColumn("f", F.col("token") % 20)
    mean = (F.sum("quote") / F.count(F.lit(1)))
    k = s.filter("not removed").groupBy("pool", "f").agg(F.count(F.lit(1)).alias("n"), mean.alias("score"))
    c = s.filter("removed and log_index % 7 < 5").groupBy("pool", "f", (F.col("log_index") % 2).alias("control")).agg(mean.alias("control_score"))
    return X.survivors(k, c, ["pool", "f"], 2, "score", "control_score").select("pool", "f", "n", r("score", "score", 8))


@query(f"{SW}, k AS (SELECT pool, token, count(*) AS n, sum(quote) AS score FROM swaps GROUP BY 1, 2 HAVING count(*) >= 2) SELECT pool, token, n, round(score, 4) AS score FROM k QUALIFY row_number() OVER (PARTITION BY pool ORDER BY CASE WHEN n < 4 THEN 1 ELSE 0 END, score DESC, token) = 1")
def srt_05_supported_argmax(spark, d):
    k = swaps(spark, d).groupBy("pool", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("quote").alias("score"))
    return X.supported_argmax(k, ["pool"], "score", "n", 4, 2, ["token"]).select("pool", "token", "n", r("score", "score", 4))


@query("SELECT 'order' AS part, o_orderkey AS k, o_totalprice AS price, NULL AS size FROM orders UNION ALL SELECT 'part', p_partkey, p_retailprice, p_size FROM part UNION ALL SELECT 'customer', c_custkey, NULL, NULL FROM customer")
def srt_06_union_parts(spark, d):
    o = scan(spark, d, "orders").select(F.lit("order").alias("part"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    p = scan(spark, d, "part").select(F.lit("part").alias("part"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    return X.union_parts(o, p, scan(spark, d, "customer").select(F.lit("customer").alias("part"), F.col("c_custkey").alias("k")))


@query(f"""{TR}, m AS (SELECT ts_us // {DAY} AS day, ts_us, 0 AS kind, event_id FROM ticks UNION ALL SELECT ts_us // {DAY}, ts_us, 1, event_id FROM trades WHERE side <> 'unknown' UNION ALL SELECT vec_id * 10000000 // {DAY}, vec_id * 10000000, 2, vec_id FROM embeddings) SELECT kind, event_id, row_number() OVER (ORDER BY ts_us, kind, event_id) - 1 AS seq FROM m""")
def srt_10_ordered_merge(spark, d):
    """Quotes, trades and book updates by time and kind, numbered anew."""
    part = lambda df, kind, key="event_id": df.select(M.bucket("ts_us", DAY).alias("day"), "ts_us", F.lit(kind).alias("kind"), F.col(key).alias("event_id"))
    e = scan(spark, d, "embeddings").select("vec_id", (F.col("vec_id") * 10_000_000).alias("ts_us"))
    m = X.union_parts(part(quotes(spark, d), 0), part(trades(spark, d).filter("side != 'unknown'"), 1), part(e, 2, "vec_id"))
    return X.with_sequence(m, "day", ["ts_us", "kind", "event_id"]).select("kind", "event_id", "seq")
