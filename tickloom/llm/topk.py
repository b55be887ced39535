"""Exact top-k inner products with a KD-tree per shard.

Shards are the cells of a coarse tree of median splits, fitted on a bounded
sample and applied to every row; a cell with more rows than a shard may hold is
dealt out over several shards.  Each shard is a KD-tree with tight bounding
boxes.  A query visits the shard with the largest inner product that its box
allows; the kth score found there prunes the shards before anything is sent to
them.  A shard's tree is loaded once per part of its queries, which stream past
it, each walking the tree best first until no box can reach its kth score.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, materialise

SCALE = 256
LEAF = 64
SHARD_ROWS = 8192
#: the coarse tree: cells at least and at most, and the sample it is fitted on
MIN_CELLS, MAX_CELLS, SAMPLE = 32, 4096, 16384
#: queries that one loading of a tree serves
PART_QUERIES = 20_000
_SCORES = "query_row long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(256 * x) of every usable vector, as often as it comes.

    Vectors that are null or hold null or non-finite components, and null ids,
    take no part; components beyond the range of long are held at its ends.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    ok = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("q"))


def _matrix(rows, width: int = 0) -> np.ndarray:
    """Rows of unequal length are filled up with zeros."""
    width = max([width, *(len(r) for r in rows)])
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class KDTree:
    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, lo, hi, span, child):
        self.points, self.ids, self.rows, self.lo, self.hi, self.span, self.child = points, ids, rows, lo, hi, span, child

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> KDTree:
        order, lo, hi, span, child, todo = np.arange(len(ids)), [], [], [], [], [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(span)
            own = points[order[a:b]]
            lo.append(own.min(axis=0)), hi.append(own.max(axis=0)), span.append((a, b)), child.append([-1, -1])
            if parent >= 0:
                child[parent][side] = me
            if b - a > leaf:
                axis, mid = int(np.argmax(hi[me].astype(float) - lo[me])), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], mid, kind="introselect")]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        return cls(points[order], ids[order], rows[order], np.array(lo), np.array(hi), np.array(span), np.array(child))

    def dump(self) -> bytes:
        out, p = io.BytesIO(), self.points
        small = next(t for t in (np.int16, np.int32, np.int64) if p.size == 0 or (p.min() >= np.iinfo(t).min and p.max() <= np.iinfo(t).max))
        np.savez(out, points=p.astype(small), ids=self.ids, rows=self.rows, lo=self.lo.astype(small), hi=self.hi.astype(small), span=self.span, child=self.child)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> KDTree:
        with np.load(io.BytesIO(data)) as z:
            return cls(*(z[k] for k in ("points", "ids", "rows", "lo", "hi", "span", "child")))

    def prepare(self, queries: np.ndarray) -> tuple[KDTree, np.ndarray]:
        """Tree and queries of equal widths, in numbers whose inner products are exact."""
        width = max(queries.shape[1], self.points.shape[1])
        wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        top = lambda m: max((abs(int(m.min())), abs(int(m.max()))), default=0) if m.size else 0
        kind = np.float64 if top(queries) * top(self.points) * max(width, 1) < 2**53 else object
        points, lo, hi = (wide(m).astype(kind) for m in (self.points, self.lo, self.hi))
        return KDTree(points, self.ids, self.rows, lo, hi, self.span, self.child), wide(queries).astype(kind)

    def search(self, q: np.ndarray, own: int, k: int, floor: float | None) -> list[tuple[int, int]]:
        """The k best (score, id) of the shard, but for row ``own``, that can be
        among the k best of all, given that k scores of at least ``floor`` exist
        elsewhere."""
        best: list[tuple] = []  # min-heap of (score, -id)
        reach = lambda n: np.maximum(q * self.lo[n], q * self.hi[n]).sum()
        heap = [(-reach(0), 0)]
        while heap:
            bound, n = heapq.heappop(heap)
            kth = best[0][0] if len(best) == k else None
            kth = floor if kth is None or (floor is not None and floor > kth) else kth
            if kth is not None and -bound < kth:
                break  # an equal bound may still hold a smaller id
            if self.child[n][0] >= 0:
                for c in self.child[n]:
                    heapq.heappush(heap, (-reach(c), int(c)))
                continue
            a, b = self.span[n]
            scores, ids = self.points[a:b] @ q, self.ids[a:b]
            use = self.rows[a:b] != own
            if kth is not None:
                use &= (scores >= kth).astype(bool)
            for s, i in zip(scores[use], ids[use], strict=True):
                entry = (int(s), -int(i))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(s, -i) for s, i in best]


class Coarse:
    """Median splits of a sample: (axis, cut, low child, high child); a child
    below zero is the cell -1 - child."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list[tuple[int, float, int, int]] = []
        self.cells = 0
        self.root = self._split(points, cells)

    def _split(self, points: np.ndarray, cells: int) -> int:
        spread = points.max(axis=0) - points.min(axis=0) if len(points) > 1 and points.shape[1] else np.zeros(1)
        axis = int(np.argmax(spread))
        if cells <= 1 or not spread[axis] > 0:
            self.cells += 1
            return -self.cells
        cut = float(np.median(points[:, axis]))
        low = points[:, axis] < cut
        if not low.any():
            low = points[:, axis] <= cut
            cut = float(np.nextafter(cut, np.inf))
        at = len(self.nodes)
        self.nodes.append((0, 0.0, 0, 0))
        a, b = self._split(points[low], cells // 2), self._split(points[~low], cells - cells // 2)
        self.nodes[at] = (axis, cut, a, b)
        return at

    def place(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int32), [(self.root, np.arange(len(points)))]
        while todo:
            n, rows = todo.pop()
            if n < 0:
                out[rows] = -1 - n
                continue
            axis, cut, a, b = self.nodes[n]
            low = points[rows, axis] < cut if axis < points.shape[1] else np.full(len(rows), 0 < cut)
            todo += [(a, rows[low]), (b, rows[~low])]
        return out


def _plant(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    tree = KDTree.build(_matrix(list(pdf["q"])), pdf["vec_id"].to_numpy(), pdf["row"].to_numpy())
    return pd.DataFrame({"shard": [key[0]], "tree": [tree.dump()], "lo": [tree.lo[0]], "hi": [tree.hi[0]]})


def _walk(k: int) -> Callable:
    """Rows come sorted by (shard, part, kind): a tree, then its queries."""
    ends, names = np.iinfo(np.int64), ["query_row", "query_id", "vec_id", "score"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            rows, kinds = [], b.column(2).to_pylist()
            at = 0
            while at < len(kinds):
                if kinds[at] == 0:
                    tree, at = KDTree.load(b.column(3)[at].as_py()), at + 1
                    continue
                upto = at
                while upto < len(kinds) and kinds[upto] == 1:
                    upto += 1
                mine, q = tree.prepare(_matrix(b.column(6)[at:upto].to_pylist()))
                for i in range(at, upto):
                    own, floor = b.column(4)[i].as_py(), b.column(7)[i].as_py()
                    rows += [(own, b.column(5)[i].as_py(), v, min(max(s, ends.min), ends.max)) for s, v in mine.search(q[i - at], own, k, floor)]
                at = upto
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=names)

    return walk


def _route(boxes: Broadcast, first: bool) -> Callable:
    """(row, vec_id, q, floor, home) → the same rows with a shard each: the one
    with the best bound, or every other one whose bound reaches the floor."""
    names = ["row", "vec_id", "q", "floor", "shard"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, lo, hi = boxes.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                q = _matrix(b.column(2).to_pylist(), lo.shape[1]).astype(float)
                wide = [np.pad(m, ((0, 0), (0, q.shape[1] - m.shape[1]))) for m in (lo, hi)]
                bound = np.maximum(q, 0) @ wide[1].T + np.minimum(q, 0) @ wide[0].T
                if first:
                    at, to = np.arange(len(q)), np.argmax(bound, axis=1)
                else:
                    floor = b.column(3).to_numpy(zero_copy_only=False).astype(float)  # nan where none is known
                    slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(wide[0]), np.abs(wide[1])).T + 1)  # rounding of the bounds
                    at, to = np.nonzero(~(bound + slack < floor[:, None]) & (shards[None, :] != b.column(4).to_numpy()[:, None]))
                for part in np.array_split(np.arange(len(at)), len(at) // 2048 + 1):
                    cols = [b.column(i).take(pa.array(at[part])) for i in range(4)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(shards[to[part]], pa.int32())], names=names)

    return route


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by
    ``every`` against every row but the query's own.

    ``vectors`` has vec_id and q, an array of longs.  Rows that share an id are
    queries and candidates of their own, also of each other; ties go to the
    smaller vec_id; vectors of unequal length are filled up with zeros; further
    columns are ignored; an empty table gives an empty result.  What reaches the
    driver is row counts, a sample of ``SAMPLE`` vectors and one box a shard, of
    which there are about ``2 * MAX_CELLS`` at most.
    """
    spark = vectors.sparkSession
    vectors = cut(vectors.select("vec_id", "q").withColumn("row", F.monotonically_increasing_id()))
    n = vectors.count()
    shard_rows = max(shard_rows, n // MAX_CELLS)
    sample = [r.q for r in vectors.orderBy(F.xxhash64(F.lit(4), "vec_id", "q")).limit(SAMPLE).select("q").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    coarse = Coarse(_matrix(sample).astype(float), min(MAX_CELLS, max(MIN_CELLS, -(-n // shard_rows))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = coarse.place(_matrix(b.column(1).to_pylist()).astype(float)) if b.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=[*b.schema.names, "cell"])

    placed = cut(vectors.mapInArrow(place, "vec_id long, q array<long>, row long, cell int"))
    dealt = placed.groupBy("cell").agg((F.floor((F.count(F.lit(1)) - 1) / shard_rows) + 1).cast("int").alias("over"))  # a row a cell
    shard = (F.col("cell") + coarse.cells * F.pmod(F.xxhash64("row"), F.col("over"))).cast("int")
    trees = placed.join(F.broadcast(dealt), "cell").withColumn("shard", shard).groupBy("shard").applyInPandas(_plant, "shard int, tree binary, lo array<long>, hi array<long>")
    trees = materialise(trees)
    found = sorted(trees.select("shard", "lo", "hi").collect())
    width = max(len(r.lo) for r in found)
    boxes = spark.sparkContext.broadcast((np.array([r.shard for r in found], np.int32), _matrix([r.lo for r in found], width).astype(float), _matrix([r.hi for r in found], width).astype(float)))
    asked = vectors.filter(F.col("vec_id") % every == 0)
    routed_kind = "row long, vec_id long, q array<long>, floor long, shard int"

    def visit(routed: DataFrame) -> DataFrame:
        parts = routed.groupBy("shard").agg((F.floor((F.count(F.lit(1)) - 1) / PART_QUERIES) + 1).cast("int").alias("parts"))  # a row a shard
        nothing = lambda kind: F.lit(None).cast(kind)
        one = trees.join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        one = one.select("shard", "part", F.lit(0).alias("kind"), "tree", nothing("long").alias("row"), nothing("long").alias("vec_id"), nothing("array<long>").alias("q"), nothing("long").alias("floor"))
        part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
        many = routed.join(F.broadcast(parts), "shard").select("shard", part.alias("part"), F.lit(1).alias("kind"), nothing("binary").alias("tree"), "row", "vec_id", "q", "floor")
        return one.union(many).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind").mapInArrow(_walk(k), _SCORES)

    none = F.lit(None).cast("long")
    first = materialise(asked.select("row", "vec_id", "q", none.alias("floor"), F.lit(0).alias("home")).mapInArrow(_route(boxes, True), routed_kind))
    scores = materialise(visit(first))
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    kth = scores.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") == k).select(F.col("query_row").alias("row"), F.col("score").alias("kth"))
    again = first.select("row", "vec_id", "q", F.col("shard").alias("home")).join(kth, "row", "left").select("row", "vec_id", "q", F.col("kth").alias("floor"), "home")
    rest = materialise(again.mapInArrow(_route(boxes, False), routed_kind))
    return scores.union(visit(rest)).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
