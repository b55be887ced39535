"""Runs, barriers, exits, boundary states, factor statistics and trade sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import safe_div
from tickloom.operators.paths import first_hit
from tickloom.operators.walk import points


def capped_run(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: str, broken: str, cap: int) -> DataFrame:
    """How many flagged rows in a row end here, at most ``cap``; a broken row
    starts anew."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("island", F.sum(F.col(broken).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("run", F.least(F.lit(cap).cast("long"), F.count_if(F.col(flag)).over(inside))).drop("island")


def rolling_pair_correlation(df: DataFrame, symbol: str, at: str, value: str, window: int, least: int, every: int) -> DataFrame:
    """Mean correlation over the pairs of a basket of symbols, in the ``window``
    steps before every ``every``-th step.  Rows go to the marks whose window
    they lie in, at most window / every + 1 each, and a pair is kept as sums."""
    marks = F.sequence((F.floor(F.col(at) / every) + 1).cast("long") * every, (F.floor((F.col(at) + window) / every) * every).cast("long"), F.lit(every).cast("long"))
    marks = F.when((F.floor(F.col(at) / every) + 1) * every <= F.col(at) + window, marks).otherwise(F.array().cast("array<long>"))
    seen = df.select(at).distinct().withColumnRenamed(at, "mark")
    x = df.withColumn("mark", F.explode(marks)).join(seen, "mark")
    # a basket is a short list of symbols, so the pairs of one step are few
    step = x.groupBy("mark", at).agg(F.sort_array(F.collect_list(F.struct(F.col(symbol).alias("s"), F.col(value).alias("v")))).alias("all"))
    pairs = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: b["s"] > a["s"]), lambda b: F.struct(a["s"].alias("i"), b["s"].alias("j"), a["v"].alias("x"), b["v"].alias("y")))))
    each = step.select("mark", F.explode(pairs).alias("p")).groupBy("mark", "p.i", "p.j").agg(F.count(F.lit(1)).alias("n"), F.corr("p.x", "p.y").alias("c"))
    good = each.filter((F.col("n") >= least) & F.col("c").isNotNull() & ~F.isnan("c"))
    return good.groupBy(F.col("mark").alias(at)).agg(F.count(F.lit(1)).alias("pairs"), F.avg("c").alias("mean"))


def prior_cuts(df: DataFrame, period: str, value: str, shares: Sequence[float], least: int) -> DataFrame:
    """bucket of each row among edges from all rows of earlier periods, or of
    the whole sample where those are fewer than ``least``.  A value goes to
    every later period; edges come from slices of the values (``points``), so no
    task holds the values of a period."""
    sizes = df.groupBy(period).agg(F.count(F.lit(1)).alias("n"))  # one row a period
    later = sizes.select(F.col(period).alias("later"))
    rows = sizes.join(F.broadcast(later), F.col(period) < F.col("later")).groupBy("later").agg(F.sum("n").alias("rows"))
    at = {f"q{k}": q for k, q in enumerate(shares)}
    x = df.select(period, F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    prior = x.join(F.broadcast(later), F.col(period) < F.col("later")).select("later", "x")
    own = rows.join(F.broadcast(points(prior, ["later"], at, few=True)), "later", "left").withColumnRenamed("later", period)
    whole = points(x, [], at, few=True)
    x = df.join(F.broadcast(own), period, "left").join(F.broadcast(whole.toDF(*(f"w_{c}" for c in whole.columns))))  # a row a period, and one
    enough = F.coalesce(F.col("rows") >= least, F.lit(False))
    edge = [F.when(enough, F.col(f"q{k}")).otherwise(F.col(f"w_q{k}")) for k in range(len(shares))]
    return x.withColumn("bucket", sum(((F.col(value) > e).cast("int") for e in edge), F.lit(0)))


def _first_of(up: Column, down: Column, path: Column, k: int) -> Column:
    both = F.when(up.isNotNull() & (up == down), "both_or_ambiguous").when(up.isNotNull() & (down.isNull() | (up < down)), "up").when(down.isNotNull(), "down")
    return both.when(F.size(path) < k, "future_missing").otherwise("none")


def triple_barrier(df: DataFrame, upper: Callable, lower: Callable, k: int) -> DataFrame:
    """label by which barrier the ``path`` of the next k elements meets first."""
    d = df.withColumns({"first_up": first_hit(F.col("path"), upper), "first_down": first_hit(F.col("path"), lower)})
    return d.withColumn("label", _first_of(F.col("first_up"), F.col("first_down"), F.col("path"), k))


def scaled_barrier(df: DataFrame, side: str, sigma: str, bar: str, k: int) -> DataFrame:
    """continuation and reversal of a side under one barrier of costs and
    volatility: dead_zone, tradable or risk_first, or what is missing."""
    move = lambda p: F.col(side) * F.log(p / F.col("price"))
    d = df.withColumns({"fav": first_hit(F.col("path"), lambda p: move(p) >= F.col(bar)), "adv": first_hit(F.col("path"), lambda p: move(p) <= -F.col(bar))})

    def status(a: str, b: str) -> Column:
        missing = F.when(F.col(side) == 0, "missing_side").when(F.col(sigma).isNull(), "missing_volatility").when(F.size("path") < k, "missing_future")
        return missing.when(F.col(a).isNull() & F.col(b).isNull(), "dead_zone").when(F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) < F.col(b))), "tradable").otherwise("risk_first")

    return d.withColumns({"continuation": status("fav", "adv"), "reversal": status("adv", "fav")})


def bar_exit(df: DataFrame, target: float, stop: float, min_hold: int, max_gap: int, k: int) -> DataFrame:
    """How an entry at ``c`` ends within its ``path`` of k bars (hi, lo, c,
    gate, b): a gap in the data, the stop (which wins a tie with the target),
    the target, the gate going off after ``min_hold`` bars, or the time."""
    late = F.array_position(F.transform("path", lambda p, i: p["b"] - F.col("b") > i + 1 + max_gap), True)
    off = F.array_position(F.transform("path", lambda p, i: (i + 1 >= min_hold) & ~p["gate"]), True)
    none = lambda c: F.nullif(c, F.lit(0).cast("long"))
    d = df.withColumns({"tp": first_hit(F.col("path"), lambda p: p["hi"] >= F.col("c") * target), "sl": first_hit(F.col("path"), lambda p: p["lo"] <= F.col("c") * stop), "off": none(off), "late": none(late)})
    at = F.least("tp", "sl", "off", "late", F.lit(k).cast("long"))
    d = d.withColumn("ends", at)
    is_ = lambda c: F.coalesce(F.col(c) == F.col("ends"), F.lit(False))
    reason = F.when(F.size("path") == 0, "no_future").when(is_("late"), "data_gap").when(is_("sl"), "stop").when(is_("tp"), "target").when(is_("off"), "gate_off").when(F.size("path") >= k, "timeout").otherwise("open")
    held = F.when(F.size("path") > 0, F.least("ends", F.size("path").cast("long")))
    return d.withColumns({"reason": reason, "tie": is_("sl") & is_("tp"), "bars_held": held})


def boundary_state(df: DataFrame, by: str, ts_us: str, order: str, day_us: int, parts: int) -> DataFrame:
    """At the end of each of ``parts`` stretches of a day, the last row of every
    key seen that day strictly before it.  A row belongs to the boundaries
    after it; the last row of each stretch is carried on over empty ones."""
    step = day_us // parts
    d = df.withColumns({"day": F.floor(F.col(ts_us) / day_us).cast("long"), "part": (F.floor(F.pmod(F.col(ts_us), F.lit(day_us)) / step) + 1).cast("int")})
    last = d.groupBy(by, "day", "part").agg(F.max_by(order, F.struct(ts_us, order)).alias(order))
    upto = F.coalesce(F.lead("part").over(Window.partitionBy(by, "day").orderBy("part")), F.lit(parts + 1)) - 1
    return last.withColumn("upto", upto).withColumn("boundary", F.explode(F.sequence("part", "upto"))).withColumn("at", (F.col("day") * day_us + F.col("boundary") * step).cast("long"))


def continuity(df: DataFrame, by: Sequence[str], at: str, step: int) -> DataFrame:
    """Gaps and duplicates of each series, and whether it has none."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(*by).orderBy(at))
    return df.withColumn("gap", gap).groupBy(*by).agg(F.count_if(F.col("gap") > step).alias("gaps"), F.count_if(F.col("gap") == 0).alias("duplicates"), (F.count_if(F.col("gap") != step) == 0).alias("continuous"))


def assert_continuous(df: DataFrame, by: Sequence[str], at: str, step: int) -> DataFrame:
    """``df`` as it is; the job fails where a series has a gap or duplicate."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(*by).orderBy(at))
    ok = gap.isNull() | (gap == step)
    return df.withColumn(at, F.when(ok, F.col(at)).otherwise(F.raise_error(F.concat(F.lit("series is broken at "), F.col(at).cast("string"))).cast(dict(df.dtypes)[at])))


def mann_whitney_share(df: DataFrame, by: Sequence[str], high: Column, value: str) -> DataFrame:
    """Share of (high, low) pairs in which the high value is larger, ties as
    halves, by running sums over the counts of the different values."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(high).alias("a"), F.count_if(~high).alias("b"))
    below = F.coalesce(F.sum("b").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("won", F.col("a") * (below + F.col("b") / 2))
    return c.groupBy(*by).agg(safe_div(F.sum("won"), F.sum("a") * F.sum("b")).alias("share"))


def correlation_pairs(df: DataFrame, factors: Sequence[str], limit: float) -> DataFrame:
    """Correlation of every pair of factors in one pass, and whether it is over
    the limit."""
    pairs = [(a, b) for k, a in enumerate(factors) for b in factors[k + 1 :]]
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)))
    return one.select("n", F.explode(rows).alias("p")).select("p.a", "p.b", "n", "p.corr", (F.abs("p.corr") > limit).alias("over_limit"))


def quantile_conventions(df: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    """The q-quantile three ways: linear between ranks, the rank nearest to
    (n − 1)·q, and the value at floor(k·q) among the k different values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))
    w, every = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    d = counts.withColumns({"upto": F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(every), "place": F.row_number().over(w) - 1, "m": F.count(F.lit(1)).over(every)})
    holds = lambda rank: (F.col("upto") - F.col("k") <= rank) & (F.col("upto") > rank)
    at = (F.col("n") - 1) * q
    pick = lambda test: F.max(F.when(test, F.col(value)))
    g = d.groupBy(*by).agg(pick(holds(F.floor(at))).alias("low"), pick(holds(F.ceil(at))).alias("high"), F.max(at - F.floor(at)).alias("part"), pick(holds(F.round(at))).alias("nearest"), pick(F.col("place") == F.floor(F.col("m") * q)).alias("at_distinct"))
    return g.select(*by, (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("linear"), "nearest", "at_distinct")


def scoring(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """Log loss, Brier score, lift of the top tenth by score, and correlation."""
    w = Window.partitionBy(*by)
    d = df.withColumns({"place": F.row_number().over(w.orderBy(F.desc(p), F.desc(y))), "n": F.count(F.lit(1)).over(w)})
    hit, x = F.col(y), F.col(p)
    top = F.avg(F.when(F.col("place") <= F.ceil(F.col("n") / 10), hit))
    return d.groupBy(*by).agg((-F.avg(hit * F.log(x) + (1 - hit) * F.log(1 - x))).alias("log_loss"), F.avg((x - hit) * (x - hit)).alias("brier"), safe_div(top, F.avg(hit)).alias("top_lift"), F.corr(p, y).alias("ic"))


def peak_exposure(legs: DataFrame, entry: str, exit_: str, weight: str) -> DataFrame:
    """Peak and 95th percentile of the weight open after each instant, exits of
    an instant taken before its entries.  Events are summed by instant before
    anything is put in order."""
    ends = F.array(F.struct(F.col(entry).alias("at"), F.col(weight).alias("w")), F.struct(F.col(exit_).alias("at"), (-F.col(weight)).alias("w")))
    net = legs.select(F.explode(ends).alias("e")).groupBy("e.at").agg(F.sum("e.w").alias("w"))
    open_ = net.select(F.sum("w").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias("open"))
    return open_.agg(F.max("open").alias("peak"), F.percentile("open", 0.95).alias("p95"), F.count(F.lit(1)).alias("steps"))


def scaled_to_cap(legs: DataFrame, by: Sequence[str], weight: str, cap: float) -> DataFrame:
    """All legs times min(1, cap / peak of the weights summed by ``by``)."""
    peak = legs.groupBy(*by).agg(F.sum(weight).alias("open")).agg(F.max("open").alias("peak"))  # one row
    return legs.join(F.broadcast(peak)).withColumn("scaled", F.col(weight) * F.least(F.lit(1.0), cap / F.col("peak"))).drop("peak")


def capacity_clip(legs: DataFrame, by: Sequence[str], order: Sequence[str], want: str, cap: float) -> DataFrame:
    """Fills in order: what is wanted, as far as the capacity is not used up by
    what was wanted before (which is then used up for good)."""
    before = F.coalesce(F.sum(want).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return legs.withColumn("fill", F.greatest(F.lit(0.0), F.least(F.col(want), cap - before)))


def attribution(base: DataFrame, later: DataFrame, key: str, period: str, cell: str, payoff: str) -> DataFrame:
    """Each period's total as exposure (its rows at the key's baseline mean),
    composition (its cells at their baseline means, less that) and payoff (the
    rest); and the cell with the worst payoff effect."""
    cells = base.groupBy(key, cell).agg(F.count(F.lit(1)).alias("bn"), F.avg(payoff).alias("bp"))
    means = cells.groupBy(key).agg((F.sum(F.col("bn") * F.col("bp")) / F.sum("bn")).alias("mean"))
    now = later.groupBy(key, period, cell).agg(F.count(F.lit(1)).alias("n"), F.avg(payoff).alias("p"))
    x = now.join(means, key).join(cells.drop("bn"), [key, cell], "left").withColumn("bp", F.coalesce("bp", "mean"))
    x = x.withColumn("effect", F.col("n") * (F.col("p") - F.col("bp")))
    return x.groupBy(key, period).agg(F.sum(F.col("n") * F.col("mean")).alias("exposure"), F.sum(F.col("n") * (F.col("bp") - F.col("mean"))).alias("composition"), F.sum("effect").alias("payoff"), F.min_by(cell, F.struct("effect", cell)).alias("worst"))
