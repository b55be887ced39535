"""Reading partitioned datasets, and the market views of the star schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_partitioned(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """A dataset under ``root/dt=…/``; with a schema, types must agree."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(root)


def scan_optional(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """No rows, instead of an error, where the dataset does not exist."""
    try:
        return spark.read.schema(schema).parquet(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def with_optional(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Columns that older parts lack read as null of the given type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def latest_snapshot(df: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of the newest snapshot, one per key."""
    newest = df.agg(F.max(at).alias("__at"))
    return df.join(F.broadcast(newest), df[at] == F.col("__at")).drop("__at").dropDuplicates([key])  # one row


def write_partitioned(df: DataFrame, root: str, run_tag: str, by: str = "dt") -> None:
    """One part set per day and run; a rerun replaces only its own."""
    df.withColumn("run_tag", F.lit(run_tag)).write.option("partitionOverwriteMode", "dynamic").partitionBy(by, "run_tag").mode("overwrite").parquet(root)


def swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swap events: base, quote, price, direction by pool and transaction."""
    li = scan(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("tx"),
        F.col("l_linenumber").alias("log_index"),
        F.col("l_suppkey").alias("pool"),
        F.col("l_partkey").alias("token"),
        F.col("l_shipdate").alias("ts"),
        F.to_date("l_shipdate").alias("day"),
        F.col("l_quantity").alias("base"),
        F.col("l_extendedprice").alias("quote"),
        (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("price"),
        F.when(F.col("l_returnflag") == "A", "buy_base").when(F.col("l_returnflag") == "R", "sell_base").otherwise("unknown").alias("direction"),
        (F.col("l_linestatus") == "F").alias("removed"),
        F.col("l_discount").alias("fee"),
    )


SWAPS_SQL = """swaps AS (SELECT l_orderkey AS tx, l_linenumber AS log_index, l_suppkey AS pool, l_partkey AS token,
 l_shipdate AS ts, CAST(l_shipdate AS DATE) AS day, l_quantity AS base, l_extendedprice AS quote,
 l_extendedprice / NULLIF(l_quantity, 0) AS price,
 CASE l_returnflag WHEN 'A' THEN 'buy_base' WHEN 'R' THEN 'sell_base' ELSE 'unknown' END AS direction,
 l_linestatus = 'F' AS removed, l_discount AS fee FROM lineitem)"""


def micros(column: str) -> Column:
    """Epoch micros of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast({column} as timestamp_ntz))")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick stream: symbol, time, kind, price."""
    return scan(spark, sf_dir, "events").select(F.col("event_id"), F.col("user_id").alias("symbol"), "ts", micros("ts").alias("ts_us"), F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), F.col("value").alias("price"), "props")


TICKS_SQL = """ticks AS (SELECT event_id, user_id AS symbol, ts, epoch_us(ts) AS ts_us, CAST(ts AS DATE) AS day,
 event_type AS kind, value AS price, props FROM events)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-of-book quotes around the price of every tick.  The factors are
    quotients of whole numbers: the doubles nearest to the SQL's decimals."""
    t, p, k = ticks(spark, sf_dir), F.col("price"), F.col("event_id")
    return t.select("symbol", "ts_us", "event_id", (p * ((10_000 - 5 * (1 + k % 4)) / 10_000)).alias("bid"), (p * ((10_000 + 5 * (1 + k % 3)) / 10_000)).alias("ask"), (1 + k % 7).cast("double").alias("bid_size"), (1 + k % 5).cast("double").alias("ask_size"))


QUOTES_SQL = f"""{TICKS_SQL}, quotes AS (SELECT symbol, ts_us, event_id, price * (1 - 0.0005 * (1 + event_id % 4)) AS bid, price * (1 + 0.0005 * (1 + event_id % 3)) AS ask,
 CAST(1 + event_id % 7 AS DOUBLE) AS bid_size, CAST(1 + event_id % 5 AS DOUBLE) AS ask_size FROM ticks)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: a tick's price, an amount, and a side by its kind."""
    side = F.when(F.col("kind") == "purchase", "buy").when(F.col("kind") == "error", "sell").otherwise("unknown")
    return ticks(spark, sf_dir).select("symbol", "ts_us", "event_id", "price", (1 + F.col("event_id") % 11).cast("double").alias("amount"), side.alias("side"))


TRADES_SQL = f"""{TICKS_SQL}, trades AS (SELECT symbol, ts_us, event_id, price, CAST(1 + event_id % 11 AS DOUBLE) AS amount,
 CASE kind WHEN 'purchase' THEN 'buy' WHEN 'error' THEN 'sell' ELSE 'unknown' END AS side FROM ticks)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of 25 levels a side, best first; sizes from a vector."""
    base, size = 100 + (F.col("vec_id") % 10) * 0.1, lambda v: F.abs(v.cast("double")) + 0.01
    e = scan(spark, sf_dir, "embeddings").withColumn("base", base)
    side = lambda at, sign: F.transform(F.slice("embedding", at, 25), lambda v, i: F.struct((F.col("base") + sign * 0.5 * (i + 1)).alias("price"), size(v).alias("size")))
    return e.select(F.col("label").alias("symbol"), "vec_id", (F.col("vec_id") * 10_000_000).alias("ts_us"), side(1, -1).alias("bids"), side(26, 1).alias("asks"))


BOOKS_SQL = """books AS (SELECT label AS symbol, vec_id, vec_id * 10000000 AS ts_us, 100 + (vec_id % 10) * 0.1 AS base,
 [abs(CAST(x AS DOUBLE)) + 0.01 FOR x IN embedding[1:25]] AS bq, [abs(CAST(x AS DOUBLE)) + 0.01 FOR x IN embedding[26:50]] AS aq FROM embeddings)"""


def latest_run(spark: SparkSession, root: str, run_tag: str | None = None) -> DataFrame:
    """The parts of one run, by default of the last in name order; a tag that
    no part has is an error.  The tag is a partition column, so other parts are
    never read."""
    parts = spark.read.parquet(root)
    tags = [r.run_tag for r in parts.select("run_tag").distinct().orderBy("run_tag").collect()]  # one row a run
    chosen = run_tag if run_tag is not None else (tags[-1] if tags else None)
    if chosen not in tags:
        raise ValueError(f"no part of run {chosen!r} under {root}")
    return parts.filter(F.col("run_tag") == chosen)


def current_dimension(snapshots: DataFrame, key: str, at: str, order: Column) -> DataFrame:
    """Rows of the newest snapshot, one per key, the first by ``order``."""
    newest = snapshots.agg(F.max(at).alias("newest_at"))  # one row
    now = snapshots.join(F.broadcast(newest), F.col(at) == F.col("newest_at")).drop("newest_at")
    best = F.max_by(F.struct(*now.columns), order)
    return now.groupBy(key).agg(best.alias("best_row")).select("best_row.*")


KLINE = "epoch long, open double, high double, low double, close double, volume double"


def read_klines(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV bars whose epoch's unit is told by its magnitude → bars
    with ts_us, minute and what is wrong with them."""
    from tickloom.functions.scalars import epoch_micros

    bars = spark.read.schema(KLINE).csv(path).withColumn("ts_us", epoch_micros(F.col("epoch")))
    bad = F.least("open", "high", "low", "close") <= 0
    return bars.withColumns({"minute": F.floor(F.col("ts_us") / 60_000_000).cast("long"), "bad_price": bad, "bad_volume": F.col("volume") < 0})


def kline_quality(bars: DataFrame, by: list[str]) -> DataFrame:
    each = bars.groupBy(*by, "minute").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad_price").alias("p"), F.count_if("bad_volume").alias("v"))
    return each.groupBy(*by).agg(F.sum("n").alias("bars"), F.sum(F.col("n") - 1).alias("duplicate_minutes"), F.sum("p").alias("bad_prices"), F.sum("v").alias("bad_volumes"))


def read_named_csv(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """CSV files, packed or not, whose columns are found by the names in their
    header; ones that are missing are an error."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in columns.items()))


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file; an infinite or undefined number in it
    fails the job before anything is written."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    bad = [F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in numbers]
    found = df.agg(*bad).first().asDict() if bad else {}
    if any(found.values()):
        raise ValueError(f"numbers that are not finite: {found}")
    df.coalesce(1).write.option("header", True).csv(path)


def canonical_quotes(raw: DataFrame, zeros: bool = False) -> tuple[DataFrame, DataFrame]:
    """Quotes with a dense seq per symbol and day, mid and spread_bps; and
    apart the rows that are not positive or are crossed.  With ``zeros``, rows
    whose sides are both 0 are quotes too, of an undefined spread."""
    from pyspark.sql import Window

    from tickloom.functions.scalars import quotient

    ok = (F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("bid") < F.col("ask"))
    if zeros:
        ok = ok | (F.col("bid") == 0) & (F.col("ask") == 0)
    ok = F.coalesce(ok, F.lit(False))
    mid = (F.col("bid") + F.col("ask")) / 2
    w = Window.partitionBy("symbol", "day").orderBy("ts_us", "event_id")
    good = raw.filter(ok).withColumns({"seq": F.row_number().over(w) - 1, "mid": mid, "spread_bps": quotient(F.col("ask") - F.col("bid"), mid) * 1e4})
    return good, raw.filter(~ok)


def canonical_trades(raw: DataFrame, side: str) -> DataFrame:
    """Trades with one spelling of the side, their notional and a dense seq."""
    from pyspark.sql import Window

    s = F.lower(F.trim(side))
    known = F.when(s.isin("b", "buy", "bid"), "buy").when(s.isin("s", "sell", "ask"), "sell").otherwise("unknown")
    w = Window.partitionBy("symbol", "day").orderBy("ts_us", "event_id")
    return raw.withColumns({"side": known, "notional_quote": F.col("price") * F.col("amount"), "seq": F.row_number().over(w) - 1})


def inventory(datasets: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and least and greatest time of every dataset."""
    one = [df.agg(F.count(F.lit(1)).alias("rows"), F.min(at).cast("timestamp_ntz").alias("first"), F.max(at).cast("timestamp_ntz").alias("last")).withColumn("dataset", F.lit(name)) for name, (df, at) in datasets.items()]
    out = one[0]
    for df in one[1:]:
        out = out.unionByName(df)
    return out
