"""Jobs over several batches, and resumed ones, against the whole at once."""

from pyspark.sql import functions as F

from tickloom.operators import paths as P
from tickloom.streaming import jobs


def test_batches_carry_state(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "job")
    rows = [(k, t, float((t * 7 + k) % 11) if t % 5 else None) for t in range(12) for k in (1, 2)]
    for i in range(3):  # three files, one batch each
        part = [x for x in rows if x[1] // 4 == i]
        spark.createDataFrame(part, "k int, t long, x double").coalesce(1).write.mode("append").parquet(src)
    want = {}
    for k in (1, 2):
        y = 0.0
        for _, t, x in sorted(r for r in rows if r[0] == k):
            y = y if x is None else max(0.0, y + x - 5)
            want[k, t] = y
    step = lambda y, v: y if v is None else max(0.0, y + v - 5)
    run = lambda: jobs.append(jobs.keyed_scan(jobs.file_stream(spark, src, 1), "k", ["t"], "x", "g", step), out)
    assert {(r.k, r.t): r.g for r in run().collect()} == want
    assert run().count() == len(rows)  # a second run finds nothing new
    sums = jobs.file_stream(spark, src, 1).groupBy("k").agg(F.count("x").alias("n"), F.sum("x").alias("s"))
    got = {r.k: (r.n, r.s) for r in jobs.upsert(sums, ["k"], str(tmp_path / "sums")).collect()}
    assert got == {k: (len(v), sum(v)) for k in (1, 2) for v in [[x for kk, _, x in rows if kk == k and x is not None]]}
    seen = jobs.run_record(jobs.file_stream(spark, src, 1), "t", str(tmp_path / "runs")).collect()
    assert len(seen) == 3 and sum(r.n for r in seen) == len(rows)


def test_expanding_percentile(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([3.0, None, 3.0, 5.0, 1.0])], "k int, i int, x double")
    past = P.expanding_percentile(df, ["k"], ["i"], "x", 1).orderBy("i").collect()
    assert [r.pct for r in past] == [None, None, 0.5, 1.0, 0.0]
    both = P.expanding_percentile(df, ["k"], ["i"], "x", 1, inclusive=True).orderBy("i").collect()
    assert [r.pct for r in both] == [0.5, None, 0.5, 2.5 / 3, 0.125]


def _message(seq, kind, first, final, before, bids=(), asks=(), k="a"):
    return k, seq, kind, first, final, before, list(bids), list(asks)


def test_live_book_gaps_and_restarts(spark, tmp_path):
    from tickloom.streaming import book as B

    kind = f"symbol string, seq long, kind string, first_id long, final_id long, prev_id long, bids {B.LEVELS}, asks {B.LEVELS}"
    whole = ([(9.0, 1.0), (8.0, 2.0), (7.0, 0.0)], [(11.0, 3.0)])
    batches = [
        [_message(1, "diff", 1, 2, 0, [(9.0, 5.0)]), _message(2, "snapshot", None, 10, None, *whole), _message(3, "diff", 1, 9, 0, [(9.0, 7.0)]), _message(4, "diff", 10, 12, 9, [(9.5, 4.0)], [(11.0, 0.0), (10.5, 1.0)])],
        [_message(6, "diff", 13, 15, 12, [(9.5, 0.0)]), _message(5, "diff", None, 12, 12), _message(7, "diff", 17, 18, 16, [(1.0, 1.0)]), _message(8, "diff", 19, 20, 18), _message(1, "snapshot", None, 5, None, *whole, k="b"), _message(1, "diff", 1, 2, 0, k=None)],
        [_message(9, "snapshot", None, 30, None, [(5.0, 1.0)], []), _message(10, "diff", 30, 31, 30), _message(11, "snapshot", None, 40, None, *whole), _message(12, "diff", 41, 42, 40), _message(2, "diff", 3, 7, 0, asks=[(11.0, 0.0)], k="b")],
    ]
    own, got = B.rocks(spark), None
    for rows in batches:  # a batch a run: each goes on from the state of the one before
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = jobs.append(B.live_book(jobs.file_stream(own, str(tmp_path / "in"))), str(tmp_path / "job"))
    seen = {(r.symbol, r.seq): (r.status, r.bid, r.bid_size, r.ask, r.bid_levels, r.ask_levels) for r in got.collect()}
    none = (None,) * 5
    assert seen == {
        ("a", 1): ("gap", *none), ("a", 2): ("snapshot", 9.0, 1.0, 11.0, 2, 1), ("a", 3): ("old", *none), ("a", 4): ("applied", 9.5, 4.0, 10.5, 3, 1),
        ("a", 5): ("ignored", *none), ("a", 6): ("applied", 9.0, 1.0, 10.5, 2, 1), ("a", 7): ("gap", *none), ("a", 8): ("gap", *none),
        ("a", 9): ("bad_snapshot", *none), ("a", 10): ("gap", *none), ("a", 11): ("snapshot", 9.0, 1.0, 11.0, 2, 1), ("a", 12): ("gap", *none),
        ("b", 1): ("snapshot", 9.0, 1.0, 11.0, 2, 1), ("b", 2): ("applied", 9.0, 1.0, None, 2, 0),
    }
    row = got.filter("symbol = 'a' and seq = 6").first()
    assert row.mid == 9.75 and abs(row.imbalance - (9 + 16 - 10.5) / 35.5) < 1e-12
