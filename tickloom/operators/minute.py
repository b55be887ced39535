"""States per minute from quotes, depth snapshots and trades, and bar sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import quotient, safe_div
from tickloom.operators import book as B


def bucket(ts_us: str, step_us: int) -> Column:
    return F.floor(F.col(ts_us) / step_us).cast("long")


def quote_columns(df: DataFrame) -> DataFrame:
    """mid, spread_bps, top notional and the microprice's offset in bps."""
    mid = (F.col("bid") + F.col("ask")) / 2
    micro = B.microprice(F.col("bid"), F.col("bid_size"), F.col("ask"), F.col("ask_size"))
    return df.withColumns({"mid": mid, "spread_bps": quotient(F.col("ask") - F.col("bid"), mid) * 1e4, "top_notional": F.col("bid") * F.col("bid_size") + F.col("ask") * F.col("ask_size"), "micro_bps": quotient(micro - mid, mid) * 1e4})


def book_ticker_state(quotes: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Open, high, low, close mid; last bid and ask; median and last spread;
    median top notional; mean microprice offset."""
    at = F.struct(*order)
    last = lambda c: F.max_by(c, at)
    return quote_columns(quotes).groupBy(*by).agg(
        F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), last("mid").alias("close"), last("bid").alias("bid"), last("ask").alias("ask"),
        F.median("spread_bps").alias("spread_median"), last("spread_bps").alias("spread_last"), F.median("top_notional").alias("top_median"), F.avg("micro_bps").alias("micro_bps"), F.count(F.lit(1)).alias("n"),
    )


def depth_state(snapshots: DataFrame, by: Sequence[str], levels: Sequence[int] = (5, 25)) -> DataFrame:
    """Over the best n levels: mean notional per side, mean imbalance weighted
    by notional, median depth; and the mean microprice offset."""
    out = []
    for n in levels:
        bid, ask = B.notional(F.col("bids"), n), B.notional(F.col("asks"), n)
        out += [F.avg(bid).alias(f"bid_{n}"), F.avg(ask).alias(f"ask_{n}"), safe_div(F.sum(bid - ask), F.sum(bid + ask)).alias(f"imbalance_{n}"), F.median(bid + ask).alias(f"depth_{n}")]
    b, a = F.get("bids", F.lit(0)), F.get("asks", F.lit(0))
    mid = (b["price"] + a["price"]) / 2
    micro = B.microprice(b["price"], b["size"], a["price"], a["size"])
    return snapshots.groupBy(*by).agg(*out, F.avg((micro - mid) / mid * 1e4).alias("micro_bps"), F.count(F.lit(1)).alias("n"))


def trade_state(trades: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Count, amount, notional, amount by side, VWAP, last price, flow
    imbalance and the buys' share of the known sides."""
    of = lambda s: F.sum(F.when(F.col("side") == s, F.col("amount")).otherwise(0.0))
    notional = F.sum(F.col("price") * F.col("amount"))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), notional.alias("notional"), of("buy").alias("buy"), of("sell").alias("sell"), of("unknown").alias("unknown"),
        safe_div(notional, F.sum("amount")).alias("vwap"), F.max_by("price", F.struct(*order)).alias("last"), safe_div(of("buy") - of("sell"), of("buy") + of("sell")).alias("imbalance"), safe_div(of("buy"), of("buy") + of("sell")).alias("buy_share"),
    )


def depth_by_distance(levels: Column, mid: Column, shares: Sequence[float]) -> dict[float, Column]:
    """Notional of all levels within each share of the mid."""
    def within(s: float) -> Column:
        near = F.filter(levels, lambda x: F.abs(x["price"] / mid - 1) <= s)
        return F.aggregate(near, F.lit(0.0), lambda a, x: a + x["price"] * x["size"])

    return {s: within(s) for s in shares}


def swap_sums(side: Column) -> list[Column]:
    """Counts and volumes by side, net flow, count imbalance, VWAP (0 for none)."""
    part = lambda s: F.sum(F.when(side == s, F.col("quote")).otherwise(0.0))
    buys, sells = F.count_if(side == 1), F.count_if(side == -1)
    return [
        F.count(F.lit(1)).alias("swaps"), buys.alias("buys"), sells.alias("sells"), part(1).alias("buy_volume"), part(-1).alias("sell_volume"), (part(1) - part(-1)).alias("net_flow"),
        F.coalesce(safe_div(buys - sells, buys + sells), F.lit(0.0)).alias("count_imbalance"), F.coalesce(safe_div(F.sum("quote"), F.sum("base")), F.lit(0.0)).alias("vwap"),
    ]


def with_total(df: DataFrame, key: str, total: str = "all") -> DataFrame:
    """Every row under its key and once more under ``total``."""
    return df.withColumn(key, F.explode(F.array(F.col(key).cast("string"), F.lit(total))))


def basket_return(returns: DataFrame, weights: DataFrame, by: Sequence[str], symbol: str, ret: str) -> DataFrame:
    """Returns weighted over the symbols that are present, and their plain mean
    where no present symbol has a weight."""
    # the weights, one row a symbol, join by key
    x = returns.filter(F.col(ret).isNotNull()).join(weights, symbol, "left")
    weighted = quotient(F.sum(F.col(ret) * F.col("weight")), F.nullif(F.sum("weight"), F.lit(0.0)))
    return x.groupBy(*by).agg(weighted.alias("weighted"), F.avg(ret).alias("equal"), F.count(F.lit(1)).alias("symbols")).withColumn("basket", F.coalesce("weighted", "equal"))
