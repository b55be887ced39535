"""Rolling folds, the factor panel, surfaces and derived tables on small cases."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import panel as PA
from tickloom.operators import surface as SU
from tickloom.operators import windows as W
from tickloom.sources import manifest as MF


def test_rolled_frames(spark):
    rows = [(k, i, None if (i * 7 + len(k)) % 5 == 0 else float((i * 13 + 5 * len(k)) % 11)) for k in ("a", "bb") for i in range(23 if k == "a" else 2)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    for n in (1, 2, 5, 30):
        got = {(r.k, r.i): tuple(r)[3:] for r in W.rolled(df, ["k"], ["i"], [n], {"s": ("sum", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x"))}).collect()}
        for k, i, _ in rows:
            frame = lambda a, b, k=k: [x for kk, j, x in rows if kk == k and a <= j <= b and x is not None]
            now, past = frame(i - n + 1, i), frame(i - n, i - 1)
            assert got[k, i] == (sum(now), sum(past), max(now, default=None), max(past, default=None), min(now, default=None), min(past, default=None))


def test_panel_has_each_name_once(spark):
    factors = [*PA.price_factors(), *PA.flow_factors(), *PA.market_factors(), *PA.depth_factors(Window.partitionBy("k").orderBy("t"))]
    assert len({f.name for f in factors}) == len(factors) >= 90 and all(f.family and f.description for f in factors)
    assert PA.definitions(spark, factors).groupBy("family").count().count() >= 9
    with pytest.raises(ValueError, match="twice"):
        PA.factor_panel(spark.range(1), ["id"], [PA.Factor("id", "f", "d", F.lit(1.0))])
    odd = PA.factor_panel(spark.range(1), ["id"], [PA.Factor("x", "f", "d", F.lit(float("inf")))]).first()
    assert odd.x is None


def test_surface_picks(spark):
    at = "2024-01-01 00:00:00"
    rows = [
        (1, at, "2024-01-05 00:00:00", True, 50.0, 0.48, 0.1, 0.2, 0.15), (2, at, "2024-01-05 00:00:00", True, 60.0, 0.52, None, None, None), (3, at, "2024-01-05 00:00:00", False, 70.0, -0.4, 0.3, 0.2, 0.1),
        (4, at, "2024-01-05 00:00:00", True, 80.0, 0.25, 0.0, 0.5, 0.0), (5, at, "2024-01-09 00:00:00", False, 40.0, -0.5, 0.1, 0.1, 0.1), (6, at, "2023-12-31 00:00:00", True, 99.0, 0.5, 0.1, 0.2, 0.1),
        (7, at, "2024-01-05 00:00:00", True, float("nan"), 0.5, 0.1, 0.2, 0.1), (8, at, "2024-01-05 00:00:00", True, 65.0, None, 0.1, 0.2, 0.1), (9, at, "2024-02-05 00:00:00", True, 20.0, 0.5, 0.1, 0.2, 0.1),
    ]
    df = spark.createDataFrame(rows, "id int, ts string, expiry string, is_call boolean, mark_iv double, delta double, bid_price double, ask_price double, mark_price double")
    df = df.withColumns({"ts": F.to_timestamp("ts"), "expiry": F.to_timestamp("expiry"), "u": F.lit("x")})
    r = SU.surface(df, ["u"], "ts", "id").first()
    assert (r.front_dte_hours, r.next_dte_hours, r.front_instruments) == (96.0, 192.0, 5)
    assert (r.atm_iv, r.call_25d_iv, r.put_25d_iv, r.skew_25d, r.term_slope) == (60.0, 80.0, 70.0, -10.0, -20.0)  # of the calls as near, the smaller id
    assert r.spread_median == pytest.approx(0.1) and r.quote_coverage == pytest.approx(3 / 5)


def test_rank_percents(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", None), ("a", float("nan")), ("b", 2.0), ("b", 2.0)], "k string, x double")
    got = sorted((r.k, str(r.x), r.p) for r in SU.rank_percents(df, {"x": "p"}, ["k"]).collect())
    assert got == [("a", "1.0", pytest.approx(100 / 3)), ("a", "3.0", pytest.approx(250 / 3)), ("a", "3.0", pytest.approx(250 / 3)), ("a", "None", None), ("a", "nan", None), ("b", "2.0", None), ("b", "2.0", None)]


def test_a_derived_table_is_built_once_for_each_state(spark, tmp_path):
    root, out, built = str(tmp_path / "raw dir's"), str(tmp_path / "out"), []
    spark.range(5).coalesce(1).write.parquet(f"{root}/one/dt=1")
    spark.range(7).coalesce(2).write.parquet(f"{root}/two")

    def build():
        built.append(1)
        return spark.read.parquet(f"{root}/two").agg(F.count(F.lit(1)).alias("n"))

    seen = {r.dataset: (r.files, r.bytes > 0) for r in MF.inventory(MF.raw_files(spark, root)).collect()}
    assert seen == {"one": (1, True), "two": (2, True)}
    same = lambda: MF.derived_table(MF.raw_files(spark, root), out, build)
    first, again = same(), same()
    assert (first[1], again[1], len(built)) == (False, True, 1) and again[0].first().n == 7
    assert MF.derived_table(MF.raw_files(spark, root), out, build, version="2")[1] is False
    spark.range(1).write.mode("append").parquet(f"{root}/two")
    table, found = same()
    assert not found and table.first().n == 8 and len(built) == 3
    assert MF.inventory(MF.raw_files(spark, root, "*.csv")).count() == 0
