"""Queries against their SQL where some prices are 0: what is divided by them
is infinite or undefined there and not an error."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.plans import fits, market, measures, quality, sourced, state, studies, wider  # noqa: F401  (they register their queries)

SF = "/root/testdata/sf0.001"
NAMES = [
    "agg_09_minute_book",
    "agg_18_basket",
    "flt_12_wide_spread",
    "grd_09_top_of_book",
    "joi_12_cross_venue",
    "lbl_09_high_low_barrier",
    "lbl_18_conditional_entry",
    "qlt_09_longest_unchanged",
    "win_21_transitions",
    "lbl_03_two_clocks",
    "src_14_canonical_quotes",
    "src_04_klines",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("zeros")
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", path / name)
    events = spark.read.parquet(f"{SF}/events.parquet")
    zero = F.col("user_id") % 3 == 0
    events.withColumn("value", F.when(zero & (F.col("event_id") % 4 < 2), 0.0).otherwise(F.col("value"))).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", NAMES)
def test_zero_prices(spark, folder, name):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in ("events", "customer"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet{'/*.parquet' if t == 'events' else ''}'")
    cursor = c.execute(market.SQL[name])
    cols = [x[0] for x in cursor.description]
    want = sorted(repr([*map(plain, row)]) for row in cursor.fetchall())
    got = sorted(repr([*map(plain, row)]) for row in market.QUERIES[name](spark, folder).select(*cols).collect())
    assert got == want
