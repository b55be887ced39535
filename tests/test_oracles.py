"""The queries of eight plan modules against their SQL on the smallest tables."""

import datetime
import decimal
import inspect
from collections import Counter

import duckdb
import pytest

from tickloom.plans import chain, fits, market, measures, micro, quality, sourced, state, studies

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings conversations".split()
NAMES = sorted(n for m in (chain, fits, measures, micro, quality, sourced, state, studies) for n, f in vars(m).items() if inspect.isfunction(f) and f.__module__ == m.__name__ and market.QUERIES.get(n) is f and n in market.SQL)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if v != v else round(float(v), 5) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    df = market.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cursor = duck.execute(market.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(row[names.index(c)]) for c in cols) for row in cursor.fetchall())
    assert Counter(tuple(map(plain, row)) for row in df.select(*cols).collect()) == want


def test_log_words_of_the_wrong_length_fail(spark):
    from tickloom.functions.chain import pair_deltas, signed_word, unsigned_word

    df = spark.createDataFrame([("0x" + "0" * 63,)], "data string")
    with pytest.raises(Exception, match="expected length"):
        df.select(pair_deltas(df.data)).collect()
    wide = spark.createDataFrame([("1" + "0" * 63,)], "w string")
    with pytest.raises(Exception, match="over 128 bits"):
        wide.select(unsigned_word(wide.w)).collect()
    edge = spark.createDataFrame([("f" * 64,), ("f" * 63 + "0",), ("0" * 48 + "f" * 16,)], "w string")
    assert [int(r[0]) for r in edge.select(signed_word(edge.w)).collect()] == [-1, -16, 2**64 - 1]


def test_a_broken_series_fails(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4)], "k string, t long")
    with pytest.raises(Exception, match="broken at"):
        measures.ME.assert_continuous(df, ["k"], "t", 1).collect()
    assert measures.ME.assert_continuous(df.filter("t < 4"), ["k"], "t", 1).count() == 2


def test_top_of_book_rounds_as_its_sql(spark, duck):
    """Every column to its last digit: many a mid ends in half of one."""
    df = market.QUERIES["grd_09_top_of_book"](spark, SF)
    cursor = duck.execute(market.SQL["grd_09_top_of_book"])
    want = Counter(cursor.fetchall())
    assert Counter(tuple(row) for row in df.select(*(c[0] for c in cursor.description)).collect()) == want
