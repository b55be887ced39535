"""Scalar decoders and rules as queries over the tables, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import chain as CH
from tickloom.functions import scalars as S
from tickloom.plans.market import SW, TK, query, r
from tickloom.sources.tables import scan, swaps, ticks


@query(f"{SW} SELECT tx, log_index, round(quote / NULLIF(base * (log_index % 3), 0), 9) AS ratio FROM swaps")
def scl_01_safe_divide(spark, d):
    return swaps(spark, d).select("tx", "log_index", r(S.safe_div(F.col("quote"), F.col("base") * (F.col("log_index") % 3)), "ratio", 9))


@query(f"{SW} SELECT tx, log_index, round(CASE WHEN abs(fee - 0.04) < 1e-9 THEN 0 ELSE fee - 0.04 END, 9) AS over FROM swaps")
def scl_02_clean_zero(spark, d):
    return swaps(spark, d).select("tx", "log_index", r(S.clean_zero(F.col("fee") - 0.04, 1e-9), "over", 9))


@query(f"{TK} SELECT event_id, ts_us - ts_us % 60000000 AS minute_us, ts_us - ts_us % 3600000000 AS hour_us, strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM ticks")
def scl_03_floor_and_format(spark, d):
    own = F.expr("cast(ts as timestamp_ntz)")
    floor = lambda step: (F.col("ts_us") - F.pmod("ts_us", F.lit(step))).cast("long")
    return ticks(spark, d).select("event_id", floor(60_000_000).alias("minute_us"), floor(3_600_000_000).alias("hour_us"), F.date_format(own, "yyyy-MM-dd").alias("dt"), F.date_format(own, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))


@query(f"{TK} SELECT event_id, CASE event_id % 4 WHEN 2 THEN ts_us // 1000 * 1000 WHEN 3 THEN ts_us // 1000000 * 1000000 ELSE ts_us END AS us FROM ticks")
def scl_04_epoch_unit(spark, d):
    t, k = F.col("ts_us"), F.col("event_id") % 4
    n = F.when(k == 0, t * 1000).when(k == 1, t).when(k == 2, F.expr("ts_us div 1000")).otherwise(F.expr("ts_us div 1000000"))
    return ticks(spark, d).select("event_id", S.epoch_micros(n).alias("us"))


@query(f"{SW} SELECT tx, log_index, round(list_avg([x FOR x IN [base, CASE WHEN log_index % 2 = 0 THEN fee END, CASE WHEN log_index % 3 = 0 THEN price END] IF x IS NOT NULL]), 9) AS mean FROM swaps")
def scl_05_row_mean(spark, d):
    odd, third = F.when(F.col("log_index") % 2 == 0, F.col("fee")), F.when(F.col("log_index") % 3 == 0, F.col("price"))
    return swaps(spark, d).select("tx", "log_index", r(S.row_mean(F.col("base"), odd, third), "mean", 9))


def _word(n):
    """A whole number as a word of 64 hex digits, two's complement."""
    wide = F.lpad(F.lower(F.hex(F.abs(n) - F.when(n < 0, 1).otherwise(0))), 64, "0")
    return F.when(n < 0, F.translate(wide, "0123456789abcdef", "fedcba9876543210")).otherwise(wide)


@query(f"""{SW}, v AS (SELECT tx, log_index, CAST(base * 1000 AS BIGINT) AS a, CAST(round(quote * 100) AS BIGINT) AS b FROM swaps)
 SELECT tx, log_index, CAST(a AS VARCHAR) AS in_less_out_0, CAST(-b AS VARCHAR) AS in_less_out_1, CAST(-a AS VARCHAR) AS signed_0, CAST(b AS VARCHAR) AS signed_1, CAST(b * 18446744073709551616 :: HUGEINT + a AS VARCHAR) AS liquidity, CAST(-tx % 887272 AS VARCHAR) AS tick,
 CAST(a - b AS VARCHAR) AS bin_x, CAST(b AS VARCHAR) AS bin_y FROM v""")
def scl_06_log_words(spark, d):
    """Log data as three kinds of pool write it, built from the tables and decoded."""
    a, b, zero = F.expr("cast(base * 1000 as bigint)"), F.expr("cast(round(quote * 100) as bigint)"), F.lit("0" * 64)
    tick = (-F.col("tx") % 887272).cast("long")
    half = lambda x: F.substring(_word(x), 33, 32)
    wide = F.concat(F.lit("0" * 32), F.lpad(F.lower(F.hex(b)), 16, "0"), F.lpad(F.lower(F.hex(a)), 16, "0"))
    text = lambda c: c.cast("string")
    x = swaps(spark, d).select(
        "tx",
        "log_index",
        CH.pair_deltas(F.concat(F.lit("0x"), _word(a), zero, zero, _word(b))).alias("p"),
        CH.range_deltas(F.concat(F.lit("0x"), _word(-a), _word(b), _word(a), wide, _word(tick))).alias("r"),
        CH.bin_deltas(F.concat(F.lit("0x"), zero, half(b), half(a), F.lit("0" * 32), half(b))).alias("l"),
    )
    return x.select("tx", "log_index", text(F.col("p.d0")).alias("in_less_out_0"), text(F.col("p.d1")).alias("in_less_out_1"), text(F.col("r.d0")).alias("signed_0"), text(F.col("r.d1")).alias("signed_1"), text(F.col("r.liquidity")).alias("liquidity"), text(F.col("r.tick")).alias("tick"), text(F.col("l.dx")).alias("bin_x"), text(F.col("l.dy")).alias("bin_y"))


@query(f"""{SW}, v AS (SELECT tx, log_index, (CASE WHEN direction = 'sell_base' THEN -1 ELSE 1 END) * CAST(round(quote * 100) AS BIGINT) AS raw, log_index % 9 AS dec FROM swaps),
 t AS (SELECT *, lpad(CAST(abs(raw) AS VARCHAR), CAST(greatest(dec + 1, length(CAST(abs(raw) AS VARCHAR))) AS INTEGER), '0') AS s FROM v), u AS (SELECT *, left(s, CAST(length(s) - dec AS BIGINT)) AS w, rtrim(CASE WHEN dec > 0 THEN right(s, dec) ELSE '' END, '0') AS f FROM t)
 SELECT tx, log_index, CASE WHEN raw < 0 THEN '-' ELSE '' END || w || CASE WHEN f <> '' THEN '.' || f ELSE '' END AS amount, round(raw / pow(10, dec), 9) AS value FROM u""")
def scl_07_raw_amount(spark, d):
    raw = F.when(F.col("direction") == "sell_base", -1).otherwise(1) * F.expr("cast(round(quote * 100) as bigint)")
    x = swaps(spark, d).select("tx", "log_index", raw.alias("raw"), (F.col("log_index") % 9).alias("dec"))
    return x.select("tx", "log_index", CH.shifted(F.col("raw"), F.col("dec")).alias("amount"), r(F.col("raw") / F.pow(F.lit(10.0), F.col("dec")), "value", 9))


@query(f"{SW}, v AS (SELECT tx, log_index, (CASE direction WHEN 'buy_base' THEN 1 WHEN 'sell_base' THEN -1 ELSE 0 END) * base AS db, quote FROM swaps) SELECT tx, log_index, CASE WHEN db > 0 THEN 'buy' WHEN db < 0 THEN 'sell' ELSE 'unknown' END AS side, round(sign(db) * quote, 4) AS flow, round(quote / NULLIF(abs(db), 0), 9) AS price FROM v")
def scl_08_direction(spark, d):
    delta = S.side_sign(F.col("direction")) * F.col("base")
    side = F.when(delta > 0, "buy").when(delta < 0, "sell").otherwise("unknown")
    return swaps(spark, d).select("tx", "log_index", side.alias("side"), r(F.signum(delta) * F.col("quote"), "flow", 4), r(S.safe_div(F.col("quote"), F.abs(delta)), "price", 9))


@query("SELECT o_orderkey, '0x' || lpad(printf('%x', o_custkey), 40, '0') AS address, '0x' || lpad(printf('%x', o_orderkey % 65536), 8, '0') AS selector FROM orders")
def scl_09_topic_address(spark, d):
    """Topics and call data built from keys, read back."""
    o = scan(spark, d, "orders")
    topic = F.concat(F.lit("0x"), F.lpad(F.hex("o_custkey"), 64, "0"))
    call = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.col("o_orderkey") % 65536)), 8, "0"), F.lpad(F.lower(F.hex("o_custkey")), 64, "0"))
    return o.select("o_orderkey", CH.address_of(topic).alias("address"), CH.selector_of(call).alias("selector"))


@query(f"{SW} SELECT tx, log_index, round(log10(CASE WHEN log_index % 2 = 1 THEN 1 / (price * pow(10, -12)) ELSE price * pow(10, -12) END), 9) AS log_p FROM swaps WHERE price > 0")
def scl_10_sqrt_price(spark, d):
    x96 = F.sqrt("price") * float(1 << 96)
    return swaps(spark, d).filter("price > 0").select("tx", "log_index", r(F.log10(S.sqrt_price(x96, F.lit(6), F.lit(18), F.col("log_index") % 2 == 1)), "log_p", 9))


_MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"


@query("SELECT o_orderkey, 'BTC' AS underlying, CAST(o_orderdate AS DATE) + INTERVAL 30 YEAR AS expiry, floor(o_totalprice) AS strike, o_orderkey % 2 = 0 AS is_call, date_diff('day', DATE '2021-01-01', CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 YEAR AS DATE)) AS days_left FROM orders".replace("CAST(o_orderdate AS DATE) + INTERVAL 30 YEAR AS expiry", "CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 YEAR AS DATE) AS expiry"))
def scl_11_option_symbol(spark, d):
    o = scan(spark, d, "orders").withColumn("day", F.add_months(F.to_date("o_orderdate"), 360))
    month = F.substring(F.lit(_MONTHS), F.month("day") * 3 - 2, F.lit(3))
    symbol = F.concat(F.lit("BTC-"), F.dayofmonth("day").cast("string"), month, F.date_format("day", "yy"), F.lit("-"), F.floor("o_totalprice").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "-C").otherwise("-P"))
    p = S.option_symbol(symbol)
    return o.select("o_orderkey", p.alias("p")).select("o_orderkey", "p.underlying", "p.expiry", "p.strike", "p.is_call", F.datediff("p.expiry", F.lit("2021-01-01").cast("date")).cast("long").alias("days_left"))


@query(f"{SW}, v AS (SELECT tx, log_index, price * 0.99 AS x, price * (CASE WHEN log_index % 2 = 0 THEN 0.98 ELSE 1.01 END) AS y, price * (0.97 + log_index * 0.01) AS m FROM swaps) SELECT tx, log_index, round(least(x, y), 9) AS bid, round(greatest(x, y), 9) AS ask, round(greatest(least(m, greatest(x, y)), least(x, y)), 9) AS mark FROM v")
def scl_12_quote_repair(spark, d):
    p, k = F.col("price"), F.col("log_index")
    bid, ask, mark = S.repair_quote(p * 0.99, p * F.when(k % 2 == 0, 0.98).otherwise(1.01), p * (0.97 + k * 0.01))
    return swaps(spark, d).select("tx", "log_index", r(bid, "bid", 9), r(ask, "ask", 9), r(mark, "mark", 9))


@query(f"{SW}, v AS (SELECT tx, log_index, fee * 10 AS iv FROM swaps), m AS (SELECT median(iv) AS m FROM v WHERE iv > 0) SELECT tx, log_index, round(CASE WHEN m < 2 THEN iv * 100 ELSE iv END, 6) AS iv FROM v, m")
def scl_13_unit_rescale(spark, d):
    return S.rescale_fractions(swaps(spark, d).select("tx", "log_index", (F.col("fee") * 10).alias("iv")), "iv").select("tx", "log_index", r("iv", "iv"))


_CDF = "(CASE WHEN {x} >= 0 THEN 1 - {t} ELSE {t} END)"


def _phi(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return _CDF.format(x=x, t=f"(exp(-({x}) * ({x}) / 2) / 2.5066282746310002 * {poly})")


@query(f"""{SW}, v AS (SELECT tx, log_index, price AS s, quote / 25 AS k, quote / 20 AS k2, fee * 5 AS vol, tax AS years FROM (SELECT swaps.*, log_index / 12.0 AS tax FROM swaps)),
 z AS (SELECT *, CASE WHEN vol > 0 THEN ln(s / k) / (vol * sqrt(years)) ELSE 0 END AS d1, CASE WHEN vol > 0 THEN ln(s / k2) / (vol * sqrt(years)) ELSE 0 END AS d2 FROM v WHERE s > 0),
 p AS (SELECT tx, log_index, CASE WHEN vol > 0 THEN {_phi("d1")} WHEN s > k THEN 1.0 ELSE 0.0 END AS above, CASE WHEN vol > 0 THEN {_phi("d2")} WHEN s > k2 THEN 1.0 ELSE 0.0 END AS above2 FROM z)
 SELECT tx, log_index, round(above, 9) AS above, round(above - above2, 9) AS between_them FROM p""")
def scl_14_close_probability(spark, d):
    args = (F.col("fee") * 5, F.col("log_index") / 12.0)
    above, above2 = (S.close_probability(F.col("price"), F.col("quote") / n, *args) for n in (25, 20))
    return swaps(spark, d).filter("price > 0").select("tx", "log_index", r(above, "above", 9), r(above - above2, "between_them", 9))


_KIND = "CASE WHEN regexp_matches(t, '\\b(reach|dip|hit)\\b') THEN NULL WHEN regexp_matches(t, '\\bbetween\\b') THEN 'between' WHEN regexp_matches(t, '\\b(below|under|less than)\\b') THEN 'below' WHEN regexp_matches(t, '\\b(above|over|greater than)\\b') THEN 'above' WHEN regexp_matches(t, '\\bup or down\\b') THEN 'up_down' END"
_VERBS = ("above", "below", "between", "up or down", "reach above", "settle")


@query(f"""WITH v AS (SELECT p_partkey, lower(p_name || ' ' || (['above', 'below', 'between', 'up or down', 'reach above', 'settle'])[p_partkey % 6 + 1] || ' $' || p_size || (['', 'k', 'm'])[p_partkey % 3 + 1] || ' officially or if reported') AS t, p_size, p_partkey % 3 AS u FROM part)
 SELECT p_partkey, CASE WHEN regexp_matches(t, 'widget|gizmo') THEN 'device' WHEN regexp_matches(t, 'cold|hot|small') THEN 'quality' ELSE 'other' END AS category, {_KIND} AS kind, p_size * (CASE u WHEN 1 THEN 1e3 WHEN 2 THEN 1e6 ELSE 1.0 END) AS amount,
 (CASE WHEN contains(t, 'official') THEN 1.5 ELSE 0 END) + (CASE WHEN contains(t, 'report') THEN 2.0 ELSE 0 END) + (CASE WHEN contains(t, 'approximately') THEN 3.0 ELSE 0 END) AS ambiguity FROM v""")
def scl_15_market_text(spark, d):
    verb = F.get(F.array(*map(F.lit, _VERBS)), (F.col("p_partkey") % 6).cast("int"))
    unit = F.get(F.array(F.lit(""), F.lit("k"), F.lit("m")), (F.col("p_partkey") % 3).cast("int"))
    text = F.concat("p_name", F.lit(" "), verb, F.lit(" $"), F.col("p_size").cast("string"), unit, F.lit(" officially or if reported"))
    x = scan(spark, d, "part").select("p_partkey", text.alias("t"))
    return x.select("p_partkey", CH.first_category(F.col("t"), {"device": ["widget", "gizmo"], "quality": ["cold", "hot", "small"]}).alias("category"), CH.market_kind(F.col("t")).alias("kind"), S.money(F.col("t")).alias("amount"), CH.ambiguity(F.col("t"), {"official": 1.5, "report": 2.0, "approximately": 3.0}).alias("ambiguity"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, round(value, 2) AS best, 2 AS levels FROM events")
def scl_16_json_levels(spark, d):
    """Properties, and price levels written as a JSON list of pairs of strings."""
    e = scan(spark, d, "events")
    price = F.round("value", 2).cast("decimal(18,2)")
    text = F.concat(F.lit('[["'), price.cast("string"), F.lit('","1"],["'), (price - 1).cast("string"), F.lit('","2"]]'))
    levels = F.from_json(text, "array<array<string>>")
    parsed = F.transform(levels, lambda x: F.struct(F.get(x, F.lit(0)).cast("double").alias("price"), F.get(x, F.lit(1)).cast("double").alias("size")))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), parsed.alias("l")).select("event_id", "k", F.get("l", F.lit(0))["price"].alias("best"), F.size("l").alias("levels"))


@query(f"{SW} SELECT tx, log_index, round(fee * 1e4 / 1e4 * sqrt(24 * 365 / 6.0) * 100, 6) AS annual_pct, round(fee * 1e4, 6) AS bps FROM swaps")
def scl_17_vol_units(spark, d):
    annual = S.annual_from_bps(F.col("fee") * 1e4, 6.0)
    return swaps(spark, d).select("tx", "log_index", r(annual, "annual_pct"), r(S.bps_from_annual(annual, 6.0), "bps"))


@query(f"{SW} SELECT tx, log_index, CASE direction WHEN 'buy_base' THEN 1 WHEN 'sell_base' THEN -1 ELSE 0 END AS side, round((CASE direction WHEN 'buy_base' THEN 1 WHEN 'sell_base' THEN -1 ELSE 0 END) * (price / 1500 - 1) * 1e4, 6) AS gross_bps, round((CASE WHEN log_index % 2 = 0 THEN 2.0 ELSE 5.0 END) + (CASE WHEN log_index % 2 = 0 THEN 0 ELSE fee * 50 END), 6) AS cost_bps FROM swaps")
def scl_18_side_arithmetic(spark, d):
    sign, maker = S.side_sign(F.col("direction")), F.col("log_index") % 2 == 0
    return swaps(spark, d).select("tx", "log_index", sign.alias("side"), r(S.side_return_bps(sign, F.lit(1500.0), F.col("price")), "gross_bps"), r(S.trade_cost_bps(maker, 2.0, 5.0, F.col("fee") * 50), "cost_bps"))


@query(f"{SW}, m AS (SELECT tx, log_index, md5('7|' || tx || '|' || log_index) AS h FROM swaps) SELECT tx, log_index, round(list_sum([(strpos('0123456789abcdef', h[i:i]) - 1) / pow(16, i) FOR i IN range(1, 14)]), 9) AS u FROM m")
def scl_19_unit_random(spark, d):
    return swaps(spark, d).select("tx", "log_index", r(CH.stable_unit(7, F.col("tx"), F.col("log_index")), "u", 9))


@query(f"""{TK} SELECT event_id, CASE WHEN price < 20 THEN 'low' WHEN price < 60 THEN 'mid' ELSE 'high' END AS three, CASE WHEN price - 50 <= -30 THEN 'strong_negative' WHEN price - 50 <= -10 THEN 'weak_negative' WHEN price - 50 < 10 THEN 'neutral' WHEN price - 50 < 30 THEN 'weak_positive' ELSE 'strong_positive' END AS five,
 CASE WHEN price > 50 THEN 'positive' WHEN price < 50 THEN 'negative' ELSE 'zero' END AS sgn, CASE WHEN price - 50 > 25 THEN 'bid_wall' WHEN price - 50 < -25 THEN 'ask_wall' ELSE 'balanced' END AS wall, CASE WHEN hour(ts) < 8 THEN 'asia' WHEN hour(ts) < 16 THEN 'europe' ELSE 'us' END AS session FROM ticks""")
def scl_20_buckets(spark, d):
    p, x = F.col("price"), F.col("price") - 50
    hour = F.floor(F.pmod(F.col("ts_us"), F.lit(86_400_000_000)) / 3_600_000_000)
    return ticks(spark, d).select("event_id", S.three_way(p, 20, 60).alias("three"), S.signed_bucket(x, 10, 30).alias("five"), S.sign_label(x).alias("sgn"), S.wall_side(x, 25).alias("wall"), S.three_way(hour, 8, 16, ("asia", "europe", "us")).alias("session"))
