"""Registered streaming queries; each runs over the whole event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.market import TK, TORD, query, r
from tickloom.sources.tables import micros, scan
from tickloom.streaming import jobs

DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000
#: where the watermark stands after all rows: whole milliseconds, a day back
_MARK = f"m AS (SELECT max(ts_us) // 1000 * 1000 - {DAY_US} AS mark FROM ticks)"


def _events(spark, d, delay: str | None = None) -> DataFrame:
    e = jobs.file_stream(spark, f"{d}/events.parquet")
    e = e.select("event_id", F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("kind"), F.col("value").alias("price"))
    e = e.withColumn("ts_us", micros("ts")).withColumn("ts", F.timestamp_micros("ts_us"))
    return e.withWatermark("ts", delay) if delay else e


def _us(column: str, name: str):
    return F.unix_micros(column).alias(name)


@query("SELECT event_id FROM events")
def str_01_incremental_append(spark, d):
    folder = jobs.shared_folder(spark)
    jobs.append(_events(spark, d).select("event_id"), folder)
    return jobs.append(_events(spark, d).select("event_id"), folder)  # nothing new the second time


@query(f"{TK} SELECT DISTINCT symbol, kind, ts_us FROM ticks")
def str_03_dedup(spark, d):
    seen = _events(spark, d, "1 day").dropDuplicatesWithinWatermark(["symbol", "kind", "ts_us"])
    return jobs.append(seen.select("symbol", "kind", "ts_us"), jobs.shared_folder(spark))


@query(f"{TK}, {_MARK} SELECT symbol, ts_us // 1000000 * 1000000 AS second_us, count(*) AS n, round(sum(price), 6) AS amount FROM ticks, m GROUP BY 1, 2, mark HAVING min(ts_us) // 1000000 * 1000000 + 1000000 <= mark")
def str_04_second_flow(spark, d):
    g = _events(spark, d, "1 day").groupBy("symbol", F.window("ts", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("amount"))
    return jobs.append(g.select("symbol", _us("w.start", "second_us"), "n", r("amount", "amount")), jobs.shared_folder(spark))


@query(f"{TK}, {_MARK}, h AS (SELECT ts_us // {HOUR_US} AS h, count(*) AS n FROM ticks GROUP BY 1), c AS (SELECT h.* FROM h, m WHERE (h + 1) * {HOUR_US} <= mark), s AS (SELECT unnest(generate_series(min(h), max(h))) AS hour FROM c) SELECT hour, coalesce(n, 0) AS n FROM s LEFT JOIN c ON h = hour")
def str_05_closed_periods(spark, d):
    """Closed hours, once each, with zero rows for the quiet ones."""
    g = _events(spark, d, "1 day").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    closed = jobs.append(g.select((F.unix_micros("w.start") / HOUR_US).cast("long").alias("hour"), "n"), jobs.shared_folder(spark))
    spine = closed.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("hour"))
    return spine.join(closed, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"{TK} SELECT symbol, ts_us // {HOUR_US} AS hour, count(*) AS n, round(sum(price), 6) AS amount, max(price) AS hi, min(price) AS lo FROM ticks GROUP BY 1, 2")
def str_07_hourly_update(spark, d):
    g = _events(spark, d, "1 day").groupBy("symbol", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("amount"), F.max("price").alias("hi"), F.min("price").alias("lo"))
    flat = g.select("symbol", (F.unix_micros("w.start") / HOUR_US).cast("long").alias("hour"), "n", r("amount", "amount"), "hi", "lo")
    return jobs.upsert(flat, ["symbol", "hour"], jobs.shared_folder(spark))


@query(f"{TK} SELECT event_id, c_nationkey AS nation FROM ticks JOIN customer ON c_custkey = symbol")
def str_08_enrichment(spark, d):
    dim = scan(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_nationkey").alias("nation"))
    return jobs.append(_events(spark, d).join(dim, "symbol").select("event_id", "nation"), jobs.shared_folder(spark))


@query(f"{TK}, j AS (SELECT a.event_id, b.event_id AS other, a.ts_us - b.ts_us AS age FROM ticks a JOIN ticks b ON a.symbol = b.symbol AND b.ts_us BETWEEN a.ts_us - {DAY_US} AND a.ts_us WHERE a.kind = 'purchase' AND b.kind <> 'purchase') SELECT event_id, arg_max(other, (-age, other)) AS other, min(age) AS age FROM j GROUP BY event_id")
def str_09_stream_asof(spark, d):
    """A purchase with the last other event of the day before it."""
    a = _events(spark, d, "1 day").filter("kind = 'purchase'").select("event_id", F.col("symbol").alias("s"), F.col("ts").alias("t"), F.col("ts_us").alias("at"))
    b = _events(spark, d, "1 day").filter("kind != 'purchase'").select(F.col("event_id").alias("other"), "symbol", "ts", "ts_us")
    near = a.join(b, F.expr("s = symbol and ts >= t - interval 1 day and ts <= t")).select("event_id", "other", (F.col("at") - F.col("ts_us")).alias("age"))
    j = jobs.append(near, jobs.shared_folder(spark))
    return j.groupBy("event_id").agg(F.max_by("other", F.struct(-F.col("age"), "other")).alias("other"), F.min("age").alias("age"))


@query(f"{TK}, s AS (SELECT *, sum(coalesce(price - 50, 0)) OVER ({TORD}) AS s FROM ticks) SELECT event_id, round(s - least(0, min(s) OVER ({TORD})), 4) AS cusum FROM s")
def str_10_cusum(spark, d):
    step = lambda y, v: y if v is None else max(0.0, y + v - 50)
    out = jobs.keyed_scan(_events(spark, d), "symbol", ["ts_us", "event_id"], "price", "cusum", step)
    return jobs.append(out, jobs.shared_folder(spark)).select("event_id", r("cusum", "cusum", 4))


@query(f"{TK}, {_MARK}, g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= {DAY_US} THEN 0 ELSE 1 END AS new FROM ticks WINDOW w AS ({TORD})), i AS (SELECT *, sum(new) OVER ({TORD}) AS i FROM g) SELECT symbol, min(ts_us) AS start_us, max(ts_us) + {DAY_US} AS end_us, count(*) AS n FROM i, m GROUP BY symbol, i, mark HAVING max(ts_us) + {DAY_US} <= mark")
def str_11_sessions(spark, d):
    g = _events(spark, d, "1 day").groupBy("symbol", F.session_window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return jobs.append(g.select("symbol", _us("w.start", "start_us"), _us("w.end", "end_us"), "n"), jobs.shared_folder(spark))


@query(f"{TK}, {_MARK} SELECT kind, (ts_us // {DAY_US} - k) * {DAY_US} AS start_us, count(*) AS n, round(sum(price), 4) AS amount FROM ticks, m, (VALUES (0), (1)) v(k) GROUP BY kind, ts_us // {DAY_US} - k, mark HAVING (min(ts_us // {DAY_US} - k) + 2) * {DAY_US} <= mark")
def str_11_sliding(spark, d):
    g = _events(spark, d, "1 day").groupBy("kind", F.window("ts", "2 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("amount"))
    return jobs.append(g.select("kind", _us("w.start", "start_us"), "n", r("amount", "amount", 4)), jobs.shared_folder(spark))


@query(f"{TK} SELECT count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM ticks")
def str_12_run_record(spark, d):
    batches = jobs.run_record(_events(spark, d), "ts_us", jobs.shared_folder(spark))
    return batches.agg(F.sum("n").alias("n"), F.min("first").alias("first_us"), F.max("last").alias("last_us"))
