"""Operators on small hand-made rows; the SQL oracles cover the tables."""

from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import grid as G
from tickloom.operators import joins as J
from tickloom.operators import wider as X
from tickloom.operators import windows as W


def test_asof_family(spark):
    a = spark.createDataFrame([(1, 10, "x"), (1, 20, "y"), (2, 5, "z")], "k int, t long, id string")
    b = spark.createDataFrame([(1, 10, 100), (1, 15, 150), (1, 30, 300), (2, 50, 500)], "k int, t long, v int")
    run = lambda **kw: {r.id: (r.v, r.age) for r in J.asof_join(a, b, "t", ["k"], ["v"], **kw).collect()}
    assert run() == {"x": (100, 0), "y": (150, 5), "z": (None, None)}
    assert run(exact=False) == {"x": (None, None), "y": (150, 5), "z": (None, None)}
    assert run(tolerance=3)["y"] == (None, None)
    assert run(forward=True) == {"x": (100, 0), "y": (300, 10), "z": (500, 45)}
    assert run(forward=True, exact=False)["x"] == (150, 5)
    later = b.union(spark.createDataFrame([(1, 99, 1)], b.schema))
    assert {r.id: r.v for r in J.asof_join(a, later, "t", ["k"], ["v"]).collect()} == {"x": 100, "y": 150, "z": None}


def test_recursive_forms(spark):
    values = [3.0, None, -5.0, 8.0, 1.0, -20.0, 4.0, 4.0]
    df = spark.createDataFrame([(1, i, v, v is not None and v > 0) for i, v in enumerate(values)], "k int, i int, x double, f boolean")
    g, want = 0.0, []
    for v in values:
        g = g if v is None else max(0.0, g + v - 0.5)
        want.append(g)
    assert [r.cusum for r in W.cusum(df, "x", ["k"], ["i"], 0.5, 5.0).orderBy("i").collect()] == want
    on, up, down, state = [], 0, 0, False
    for v in values:
        f = v is not None and v > 0
        up, down = (up + 1, 0) if f else (0, down + 1)
        state = True if up >= 2 else False if down >= 2 else state
        on.append(state)
    assert [r.active for r in W.hysteresis(df, "f", ["k"], ["i"], 2, 2).orderBy("i").collect()] == on


def test_grid_and_thinning(spark):
    bars = spark.createDataFrame([(1, 0, 1.0), (1, 3, 4.0)], "k int, t long, v double")
    rows = G.fill_forward(G.spine(bars, ["k"], "t", 1), bars, ["k"], "t", "v").orderBy("t").collect()
    assert [(r.v, r.method) for r in rows] == [(1.0, "observed"), (1.0, "forward_fill"), (1.0, "forward_fill"), (4.0, "observed")]
    t = spark.createDataFrame([(1, x) for x in (0, 4, 5, 9, 10, 16)], "k int, t long")
    assert sorted(r.t for r in W.refractory(t, ["k"], "t", 5).collect()) == [0, 5, 10, 16]


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0, "BTC-27JUN25-60000-C", "$1.5k"), (float("nan"), 2.0, "x", "none")], "a double, b double, s string, m string")
    r = df.select(S.safe_div(F.col("a"), F.col("b")).alias("d"), S.option_symbol(F.col("s")).alias("o"), S.money(F.col("m")).alias("m"), S.row_mean(F.col("a"), F.col("b")).alias("w"), S.normal_cdf(F.col("b")).alias("c")).collect()
    assert [x.d for x in r] == [None, None] and [x.m for x in r] == [1500.0, None] and [x.w for x in r] == [0.5, 2.0]
    assert (r[0].o.underlying, str(r[0].o.expiry), r[0].o.strike, r[0].o.is_call) == ("BTC", "2025-06-27", 60000.0, True) and r[1].o is None
    assert abs(r[1].c - 0.9772498680518208) < 1e-7


def test_wider_operators(spark):
    t = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 6, 7), (1, 7, 8), (1, 8, 20), (2, 3, 3)], "k int, a long, b long")
    kept = X.non_overlapping(t, ["k"], "a", "b", ["b"]).collect()
    assert sorted((r.k, r.a) for r in kept) == [(1, 0), (1, 6), (1, 8), (2, 3)]
    entries = spark.createDataFrame([(1, 10, "x"), (1, 4, "y"), (2, 9, "z")], "k int, t long, id string")
    known = spark.createDataFrame([(1, 5, 1.0, 1), (1, 10, -2.0, 2), (1, 10, 4.0, 3), (1, 11, 9.0, 4)], "k int, t long, y double, i int")
    got = {r.id: (r.n, r.up, r.down, r.worst) for r in X.prior_outcomes(entries, known, "t", ["k"], "y", ["i"], 2).collect()}
    assert got == {"x": (2, 4.0, -2.0, -2.0), "y": (None,) * 4, "z": (None,) * 4}
    legs = spark.createDataFrame([(1, 0.0, 1.0, 0.4), (1, 1.0, 2.0, 0.5), (2, 0.0, 1.0, 0.4), (2, 1.5, 2.0, 0.2)], "e int, lo double, hi double, ask double")
    b = {r.e: (r.complete, r.n_gaps, round(r.all_yes_cost, 9)) for r in X.basket(legs, ["e"], "lo", "hi", "ask", []).collect()}
    assert b == {1: (True, 0, 0.9), 2: (False, 1, 0.6)}


def test_forward_tie_takes_the_larger(spark):
    a = spark.createDataFrame([(1, 10)], "k int, t long")
    b = spark.createDataFrame([(1, 12, 7), (1, 12, 8)], "k int, t long, v int")
    assert [r.v for r in J.asof_join(a, b, "t", ["k"], ["v"], forward=True, tie="v").collect()] == [8]
