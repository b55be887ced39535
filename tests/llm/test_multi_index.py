"""The inverted multi-index against brute force: recall, exact scores, edge rows."""

import numpy as np
import pytest

from tickloom.llm import multi_index as M

SF = "/root/testdata/sf0.01"
KIND = "vec_id long, embedding array<float>, label int, cell int, row int, v string, shard int"


def brute(rows, every=50, k=5):
    """(query_id, rank, vec_id, score) of usable rows by all cosines."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max(len(v) for _, v in ok)
    m = np.array([np.pad(v, (0, width - len(v))) for _, v in ok])
    ids, unit = np.array([i for i, _ in ok]), m / np.linalg.norm(m, axis=1, keepdims=True)
    out = []
    for a in np.flatnonzero(ids % every == 0):
        s = unit @ unit[a]
        order = [b for b in np.lexsort((ids, -s.round(12))) if b != a][:k]
        out += [(int(ids[a]), r, int(ids[b]), s[b]) for r, b in enumerate(order, 1)]
    return sorted(out)


def run(spark, rows, **more):
    table = spark.createDataFrame([(i, v, 1, 2, 3, "v", 4) for i, v in rows], KIND)
    return sorted(map(tuple, M.nearest(table, **more).collect()))


def same(got, want):
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_recall_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    got = sorted(map(tuple, M.nearest(table).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert len({g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want}) >= 0.9 * len(want)
    true = {(w[0], w[2]): w[3] for w in want}
    assert all(abs(true[g[0], g[2]] - g[3]) < 1e-12 for g in got if (g[0], g[2]) in true)


@pytest.mark.parametrize("shard_rows", [8192, 7])
def test_clusters_are_found_in_few_cells(spark, shard_rows, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=12)).astype(np.float32).tolist()) for i in range(3000)]
    budgets, plain = [], M._budget
    monkeypatch.setattr(M, "_budget", lambda *a: budgets.append(plain(*a)) or budgets[-1])
    got, want = run(spark, rows, shard_rows=shard_rows), brute(rows)
    assert len({g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want}) >= 0.9 * len(want)
    assert budgets[0] < 600  # a fifth of the rows
    # all neighbours, if the probes ask for all
    same(run(spark, rows, recall=1.0, shard_rows=shard_rows), want)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(0, 200, 2)]
    rows += [(1, None), (50, [0.0] * 6), (100, []), (150, [nan] * 6), (200, [inf, 1.0]), (250, [None, 1.0]), (None, [1.0] * 6), (300, [1.0, 2.0]), (350, [1e30, -1e30, 1e-30])]
    rows += [(1000 + i, [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]) for i in range(0, 400)]  # one vector over and over
    rows += [(1050, [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]), (400, [1.0, 0.0]), (400, [1.0, 0.0]), (400, [-0.0, 1.0])]  # equal ids
    for shard_rows in (8192, 3):
        got = run(spark, rows, recall=1.0, shard_rows=shard_rows)
        want = brute(rows)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], atol=1e-7)
        copies = {g for g in got if g[0] == 1350}
        assert {g[2] for g in copies} == {1000, 1001, 1002, 1003, 1004}
    assert {g[2] for g in got if g[0] == 1000} == {1001, 1002, 1003, 1004, 1005}


def test_few_and_no_rows(spark):
    assert run(spark, []) == [] and run(spark, [(50, None)]) == [] and run(spark, [(50, [1.0, 2.0])]) == [] and run(spark, [(7, [1.0]), (8, [2.0])]) == []
    assert run(spark, [(50, [1.0]), (1, [-2.0]), (3, [4.0])]) == [(50, 1, 3, 1.0), (50, 2, 1, -1.0)]


def test_walk_takes_cells_in_order():
    rng = np.random.default_rng(6)
    for _ in range(50):
        d1, d2, n = rng.random(7), rng.random(5), rng.integers(0, 4, (7, 5))
        total = sorted((d1[i] + d2[j], n[i, j]) for i in range(7) for j in range(5))
        for budget in (1, 5, 20, int(n.sum()), int(n.sum()) + 1):
            passed, want = 0, total[-1][0]
            for d, c in total:
                passed += c
                if passed >= budget:
                    want = d
                    break
            assert M.walk(d1, d2, n, budget) == want


def test_shards_hold_a_bounded_number():
    counts = np.array([[3, 0, 4], [20, 1, 1], [0, 8, 2]])
    first, over = M._shards(counts, 8)
    load = {}
    for c, f, o in zip(counts.ravel(), first, over, strict=True):
        for s in range(f, f + o):
            load[s] = load.get(s, 0) + c / o
    assert max(load.values()) <= 8 and over[3] == 3
