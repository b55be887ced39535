"""Order-book features over level arrays, and book states from updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import safe_div


def notional(levels: Column, n: int) -> Column:
    """Sum of price · size over the best n levels (array of price, size)."""
    return F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda a, x: a + x["price"] * x["size"])


def imbalance(bid: Column, ask: Column) -> Column:
    return safe_div(bid - ask, bid + ask)


def microprice(bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    return safe_div(bid * ask_size + ask * bid_size, bid_size + ask_size)


def walk_cost(levels: Column, amount: float) -> Column:
    """Mean price paid for a notional down the levels; null if too thin."""
    start = F.struct(F.lit(float(amount)).alias("left"), F.lit(0.0).alias("size"))

    def step(a: Column, x: Column) -> Column:
        take = F.least(a["left"], x["price"] * x["size"])
        return F.struct((a["left"] - take).alias("left"), (a["size"] + take / x["price"]).alias("size"))

    return F.aggregate(levels, start, step, lambda a: F.when(a["left"] <= 1e-9, safe_div(F.lit(float(amount)), a["size"])))


def shares_cost(levels: Column, shares: Column, fee: float) -> Column:
    """struct(cost, fee) of a number of shares down the levels, with a fee of
    ``fee`` · p · (1 − p) a share for prices p in (0, 1); null if too thin."""
    start = F.struct(shares.cast("double").alias("left"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("fee"))

    def step(a: Column, x: Column) -> Column:
        take = F.least(a["left"], x["size"])
        return F.struct((a["left"] - take).alias("left"), (a["cost"] + take * x["price"]).alias("cost"), (a["fee"] + fee * take * x["price"] * (1 - x["price"])).alias("fee"))

    return F.aggregate(levels, start, step, lambda a: F.when(a["left"] <= 1e-9, F.struct(a["cost"].alias("cost"), a["fee"].alias("fee"))))


def side_flow(p0: Column, q0: Column, p1: Column, q1: Column, sign: int) -> Column:
    """One side's order flow between two states: a better price brings its
    size, a worse one takes the size before, an equal one the difference; a
    side that appears or goes counts whole.  ``sign`` is 1 for bids, -1 for asks."""
    better, worse = (p1 > p0, p1 < p0) if sign > 0 else (p1 < p0, p1 > p0)
    flow = F.when(p0.isNull() & p1.isNull(), 0.0).when(p0.isNull(), q1).when(p1.isNull(), -q0).when(better, q1).when(worse, -q0).otherwise(q1 - q0)
    return sign * flow


def order_flow_imbalance(w, bid: str, bid_size: str, ask: str, ask_size: str) -> Column:
    """By cases; nothing before the first state."""
    now, before = ([f(c) for c in (bid, bid_size, ask, ask_size)] for f in (F.col, lambda c: F.lag(c).over(w)))
    flow = side_flow(before[0], before[1], now[0], now[1], 1) + side_flow(before[2], before[3], now[2], now[3], -1)
    return F.when(F.row_number().over(w) > 1, flow)


def indicator_imbalance(w, bid: str, bid_size: str, ask: str, ask_size: str) -> Column:
    """The same by indicators: 1[b ≥ b'] q − 1[b ≤ b'] q' − 1[a ≤ a'] r + 1[a ≥ a'] r'."""
    pb, pq, pa, pr = (F.lag(c).over(w) for c in (bid, bid_size, ask, ask_size))
    one = lambda c, q: F.when(c, q).otherwise(0.0)
    b, a = F.col(bid), F.col(ask)
    return one(b >= pb, F.col(bid_size)) - one(b <= pb, pq) - one(a <= pa, F.col(ask_size)) + one(a >= pa, pr)


def level_flows(w, n: int) -> tuple[Column, Column]:
    """Order flow of the n-th level of both sides between a state and the one
    before, and the same over the larger of the level's depths."""
    at = lambda c: F.get(c, F.lit(n - 1))
    b1, a1, b0, a0 = at(F.col("bids")), at(F.col("asks")), at(F.lag("bids").over(w)), at(F.lag("asks").over(w))
    flow = side_flow(b0["price"], b0["size"], b1["price"], b1["size"], 1) + side_flow(a0["price"], a0["size"], a1["price"], a1["size"], -1)
    depth = lambda x, y: F.coalesce(x["size"], F.lit(0.0)) + F.coalesce(y["size"], F.lit(0.0))
    flow = F.when(F.row_number().over(w) > 1, flow)
    return flow, safe_div(flow, F.greatest(depth(b0, a0), depth(b1, a1)))


def top_features(n: int = 5, deep: int = 25) -> dict[str, Column]:
    """Mid, spread, microprice, depth near and deep, imbalances, slope and
    curvature of the cumulated depth, from ``bids`` and ``asks``."""
    b, a = F.get("bids", F.lit(0)), F.get("asks", F.lit(0))
    mid = (b["price"] + a["price"]) / 2
    size = lambda c, k: F.aggregate(F.slice(c, 1, k), F.lit(0.0), lambda s, x: s + x["size"])
    far = lambda c, k: F.abs(F.get(c, F.lit(k - 1))["price"] - mid)
    half = (n + 1) // 2
    return {
        "mid": mid, "spread_bps": (a["price"] - b["price"]) / mid * 1e4, "micro": microprice(b["price"], b["size"], a["price"], a["size"]),
        f"depth_{n}": size("bids", n) + size("asks", n), f"depth_{deep}": size("bids", deep) + size("asks", deep),
        f"imbalance_{n}": imbalance(size("bids", n), size("asks", n)), f"imbalance_{deep}": imbalance(size("bids", deep), size("asks", deep)),
        "bid_slope": safe_div(size("bids", n), far("bids", n)), "ask_slope": safe_div(size("asks", n), far("asks", n)),
        "curvature": safe_div(size("bids", n) + size("asks", n) - 2 * (size("bids", half) + size("asks", half)), size("bids", n) + size("asks", n)),
    }


def uncrossed(bids: Column, asks: Column) -> Column:
    """struct(bids, asks, removed): the best of both sides go, pair by pair,
    while the bid is not below the ask."""
    n = F.least(F.size(bids), F.size(asks))
    crossed = F.when(n > 0, F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(bids, i)["price"] >= F.get(asks, i)["price"]))).otherwise(0)
    rest = lambda c: F.slice(c, crossed + 1, F.size(c))
    return F.struct(rest(bids).alias("bids"), rest(asks).alias("asks"), (2 * crossed).alias("removed"))


def reset_state(updates: DataFrame, by: list[str], level: str, order: list[str], snapshot: str, size: str) -> DataFrame:
    """The book of every key at its end: its last snapshot run starts it, later
    updates change it, an amount of 0 deletes; what comes before goes."""
    w = Window.partitionBy(*by).orderBy(*order)
    begins = F.col(snapshot) & ~F.coalesce(F.lag(snapshot).over(w), F.lit(False))
    d = updates.withColumn("book_run", F.count_if(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = d.groupBy(*by, "book_run", level).agg(F.max_by(size, F.struct(*order)).alias(size))
    newest = d.groupBy(*by).agg(F.max("book_run").alias("book_run"))
    return last.join(newest, [*by, "book_run"]).filter((F.col("book_run") > 0) & (F.col(size) > 0)).drop("book_run")


def update_class(df: DataFrame, by: list[str], order: list[str], size: str) -> DataFrame:
    """create, replenish, decrease, remove or no_op per price level."""
    prev = F.coalesce(F.lag(size).over(Window.partitionBy(*by).orderBy(*order)), F.lit(0.0))
    d = df.withColumn("__p", prev).withColumn("delta", F.col(size) - F.col("__p"))
    kind = F.when(F.col("delta") == 0, "no_op").when(F.col("__p") == 0, "create").when(F.col(size) == 0, "remove").when(F.col("delta") > 0, "replenish").otherwise("decrease")
    return d.withColumn("update_class", kind).drop("__p")


def state_at(updates: DataFrame, by: list[str], order: list[str], at: Column, size: str) -> DataFrame:
    """The last update of every level up to a time; removed levels go."""
    last = updates.filter(at).groupBy(*by).agg(F.max_by(size, F.struct(*order)).alias(size))
    return last.filter(F.col(size) > 0)
