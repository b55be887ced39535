"""Approximate nearest neighbours by cosine over an inverted multi-index.

Unit vectors are cut into two halves, and each half is quantised to its nearest
of K centroids, so that a row lies in one of K * K cells.  A query walks the
pairs of centroids in the order of their summed squared distance with a heap,
until the cells passed hold as many entries as the budget; where that walk ends
is the query's radius.  It visits the shards that hold such cells, and there
every entry whose pair of centroids lies within the radius is scored exactly on
the original vectors.

The budget comes from the table: the neighbours of a bounded set of probes are
found by brute force, one pass over the rows, and the budget is the least that
covers ``RECALL`` of them.  So a table with clusters is searched in few cells
and noise in many, at any size.  Centroids come from a bounded sample; every
row is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut

#: rows that centroids are fitted on, entries a cell should hold, centroids a half
SAMPLE, CELL_ROWS, LEAST, MOST = 16384, 12, 4, 1024
ROUNDS = 10
#: probes whose neighbours set the budget, and the share of those it covers
PROBES, RECALL = 256, 0.96
SHARD_ROWS, PART_QUERIES, BLOCK = 8192, 20_000, 256
_FOUND = "query_row long, query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v, floats or doubles, of every row with an id and a vector that
    is neither zero nor holds a null or non-finite component."""
    x = F.col("embedding")
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0)
    return vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<float>" if kind == "float" else "array<double>").alias("v"))


def _entry(rows: DataFrame, more: str) -> str:
    return f"row long, vec_id long, v {rows.schema['v'].dataType.simpleString()}, {more}"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros (and cut) to the width."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width).astype(float)
    out = np.zeros((len(size), width))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    inside = place < width
    out[np.repeat(np.arange(len(size)), size)[inside], place[inside]] = flat[inside]
    return out


def _norms(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their lengths; ones whose squares leave the range of doubles
    are scaled first, which does not change a cosine."""
    top = np.abs(m).max(axis=1, initial=0.0)
    far = (top > 1e150) | (top < 1e-150)
    if far.any():
        m = m.copy()
        m[far] /= top[far, None]
    return m, np.sqrt((m * m).sum(axis=1))


def _unit(m: np.ndarray) -> np.ndarray:
    m, length = _norms(m)
    return m / length[:, None]


def _far(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, with the same rounding for a point wherever it stands."""
    out = np.empty((len(points), len(centres)))
    for start in range(0, len(points), 64):
        p = points[start : start + 64]
        out[start : start + 64] = ((p[:, None, :] - centres) ** 2).sum(axis=2)
    return out


def centroids(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of the sorted sample."""
    found = np.unique(points, axis=0)
    found = found[np.linspace(0, len(found) - 1, min(k, len(found))).astype(int)]
    for _ in range(rounds):
        near = np.argmin((found * found).sum(axis=1) - 2 * points @ found.T, axis=1)
        order = np.argsort(near, kind="stable")
        present, first = np.unique(near[order], return_index=True)
        found[present] = np.add.reduceat(points[order], first) / np.diff(first, append=len(points))[:, None]
    return found


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, budget: int) -> float:
    """The summed distance at which the cells, nearest first, hold ``budget``
    entries: best first over pairs of ranks with a heap."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    n = counts[np.ix_(o1, o2)].tolist()
    heap, got, radius = [(s1[0] + s2[0], 0, 0)], 0, np.inf
    while heap:
        radius, i, j = heapq.heappop(heap)
        got += n[i][j]
        if got >= budget:
            return radius
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return radius


@dataclass(frozen=True)
class Index:
    """The centroids of both halves, what each cell holds, and its shards:
    ``first`` of the shard numbers and ``over`` how many it is dealt over."""

    width: int
    low: np.ndarray
    high: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    over: np.ndarray

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.width // 2
        return _far(units[:, :half], self.low), _far(units[:, half:], self.high)

    def cells(self, units: np.ndarray) -> np.ndarray:
        d1, d2 = self.distances(units)
        return d1.argmin(axis=1) * len(self.high) + d2.argmin(axis=1)


def _shards(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring cells share a shard up to ``rows`` entries; a fuller cell is
    dealt over several of its own."""
    first, over, shard, held = np.zeros(counts.size, np.int32), np.ones(counts.size, np.int32), 0, 0
    for cell in np.flatnonzero(counts.ravel()):
        n = int(counts.flat[cell])
        if held and held + n > rows:
            shard, held = shard + 1, 0
        first[cell], over[cell] = shard, -(-n // rows)
        held += n
        if over[cell] > 1:
            shard, held = shard + int(over[cell]), 0
    return first, over


def _assign(index: Index) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = index.cells(_unit(_matrix(b.column(2), index.width))) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

    return assign


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _exact(q: np.ndarray, q_length: float, m: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Cosines whose rounding hangs on the two vectors alone."""
    return (m * q).sum(axis=1) / (length * q_length)


def _score(q: np.ndarray, own: np.ndarray, m: np.ndarray, rows: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: its place, the places of its k best entries and their scores.
    A product of matrices proposes, with room for its rounding."""
    q, q_length = _norms(q)
    m, length = _norms(m)
    rough = (q / q_length[:, None]) @ (m / length[:, None]).T
    if allowed is not None:
        rough[~allowed] = -np.inf
    rough[own[:, None] == rows[None, :]] = -np.inf
    for i in range(len(q)):
        kth = np.partition(rough[i], -k)[-k] if rough.shape[1] > k else -np.inf
        at = np.flatnonzero((rough[i] >= kth - 1e-9) & (rough[i] > -np.inf))
        if len(at):
            s = _exact(q[i], q_length[i], m[at], length[at])
            top = _best(s, ids[at], k)
            yield i, at[top], s[top]


def _brute(probes: list[tuple[int, list[float]]], width: int, k: int) -> Callable:
    """Per batch, each probe's k best entries and the cell they lie in."""

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array([r for r, _ in probes])
        q = np.array([v for _, v in probes])
        for b in batches:
            if not b.num_rows:
                continue
            rows, ids, cells = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            out = [(int(own[i]), int(ids[a]), int(cells[a]), float(s)) for i, at, score in _score(q, own, _matrix(b.column(2), width), rows, ids, None, k) for a, s in zip(at, score, strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(("probe", "vec_id", "cell", "score"), r, strict=True)) for r in out], pa.schema([("probe", pa.int64()), ("vec_id", pa.int64()), ("cell", pa.int32()), ("score", pa.float64())]))

    return brute


def _budget(index: Index, probes: list[tuple[int, list[float]]], truth: list, recall: float) -> int:
    """The least number of entries to pass so that ``recall`` of the probes'
    neighbours are among them."""
    d1, d2 = index.distances(_unit(np.array([v for _, v in probes])))
    place = {r: i for i, (r, _) in enumerate(probes)}
    need = []
    for i, group in {p: [t.cell for t in truth if t.probe == p] for p in {t.probe for t in truth}}.items():
        total = (d1[place[i]][:, None] + d2[place[i]]).ravel()
        order = np.argsort(total, kind="stable")
        passed = np.cumsum(index.counts.ravel()[order])
        need += [passed[np.searchsorted(total[order], total[c], side="right") - 1] for c in group]
    need.sort()
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) if need else 1


def _route(index: Index, budget: int) -> Callable:
    """(row, vec_id, v) → the same with its radius and each shard it visits."""
    names = ["row", "vec_id", "v", "radius", "shard"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = index.counts.ravel() > 0
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                d1, d2 = index.distances(_unit(_matrix(b.column(2), index.width)))
                radius = np.array([walk(d1[i], d2[i], index.counts, budget) for i in range(b.num_rows)])
                at, to = [], []
                for i in range(b.num_rows):
                    cells = np.flatnonzero(((d1[i][:, None] + d2[i]).ravel() <= radius[i]) & full)
                    shards = np.unique(np.concatenate([index.first[cells], *(np.arange(f, f + o) for f, o in zip(index.first[cells], index.over[cells], strict=True) if o > 1)]))
                    at.append(np.full(len(shards), i)), to.append(shards)
                at, to = np.concatenate(at), np.concatenate(to)
                for part in np.array_split(np.arange(len(at)), len(at) // 4096 + 1):
                    cols = [b.column(i).take(pa.array(at[part])) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(radius[at[part]]), pa.array(to[part].astype(np.int32))], names=names)

    return route


def _search(index: Index, k: int) -> Callable:
    """Rows come sorted by (shard, part, kind): a shard's entries, of which
    there are a bounded number, then its queries, which stream past."""
    names = ["query_row", "query_id", "vec_id", "score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ready = None
        for whole in batches:
            kinds = whole.column(2).to_numpy(zero_copy_only=False)
            keys = np.stack([whole.column(0).to_numpy(zero_copy_only=False), whole.column(1).to_numpy(zero_copy_only=False), kinds], 1)
            borders = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), whole.num_rows]
            for start, stop in zip(borders, borders[1:], strict=False):
                b = whole.slice(start, stop - start)
                if not b.num_rows:
                    continue
                if kinds[start] == 0:
                    if ready is not None or (held and held[0].column(0)[0] != b.column(0)[0]) or (held and held[0].column(1)[0] != b.column(1)[0]):
                        held, ready = [], None
                    held.append(b)
                    continue
                if ready is None:
                    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    ready = (*(t.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 6)), _matrix(t.column(5), index.width))
                rows, ids, cells, m = ready
                i1, i2 = cells.astype(np.int64) // len(index.high), cells.astype(np.int64) % len(index.high)
                for at in range(0, b.num_rows, BLOCK):
                    part = b.slice(at, BLOCK)
                    q = _matrix(part.column(5), index.width)
                    d1, d2 = index.distances(_unit(q))
                    radius = part.column(7).to_numpy(zero_copy_only=False)
                    allowed = d1[:, i1] + d2[:, i2] <= radius[:, None]
                    some = np.flatnonzero(allowed.any(axis=0))
                    own, asked = part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy(zero_copy_only=False)
                    out = [(own[i], asked[i], ids[some][a], s) for i, near, score in _score(q, own, m[some], rows[some], ids[some], allowed[:, some], k) for a, s in zip(near, score, strict=True)]
                    cols = list(zip(*out, strict=True)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.array(c, np.int64)) for c in cols[:3]), pa.array(np.array(cols[3], float))], names=names)

    return search


def _spread(name: str, *by: str) -> Column:
    return F.xxhash64(F.lit(name), *by)


def build(rows: DataFrame, entries: DataFrame, n: int, width: int, shard_rows: int = SHARD_ROWS) -> tuple[Index, DataFrame]:
    """The index of ``entries`` (row, vec_id, v) and these with their cells.

    Centroids come from ``SAMPLE`` of the ``n`` rows by hash; the driver holds
    these, the centroids and a count a cell, ``MOST`` squared at most.
    """
    sample = [r.v for r in rows.orderBy(_spread("sample", "vec_id", "row")).limit(SAMPLE).select("v").collect()]
    points = np.zeros((len(sample), width))
    for i, v in enumerate(sample):
        points[i, : len(v)] = v
    points, half = np.unique(_unit(points), axis=0), width // 2
    k = int(min(MOST, max(LEAST, 2 ** round(np.log2(max(n / CELL_ROWS, 1)) / 2))))
    index = Index(width, centroids(points[:, :half], k), centroids(points[:, half:], k), *(np.zeros(0, np.int64) for _ in range(3)))
    placed = cut(entries.mapInArrow(_assign(index), _entry(entries, "cell int")))
    counts = np.zeros((len(index.low), len(index.high)), np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        counts.flat[r.cell] = r.n
    return Index(width, index.low, index.high, counts, *_shards(counts, shard_rows)), placed


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = RECALL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows whose id is divisible by
    ``every``, the k largest cosines found among all other rows, ties to the
    smaller id.

    Rows that share an id are queries and candidates of their own, also of each
    other.  Of equal vectors only the k + 1 smallest ids can be among anybody's
    k best, so further copies take no place in the cells.  Vectors of unequal
    length are filled up with zeros; further columns are ignored; an empty table
    gives an empty result.  A cell of any size is dealt over shards of
    ``shard_rows`` entries, a shard's queries over parts of ``PART_QUERIES``.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors).withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v"))
    copies = Window.partitionBy("v").orderBy("vec_id", "row")
    entries = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("row", "vec_id", "v")
    extent = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not extent.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = max(2, extent.width)
    index, placed = build(rows, entries, extent.n, width, shard_rows)
    probes = [(r.row, [*r.v, *[0.0] * (width - len(r.v))]) for r in rows.filter(F.col("vec_id") % every == 0).orderBy(_spread("probe", "vec_id", "row")).limit(PROBES).collect()]
    if not probes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranked = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
    truth = placed.mapInArrow(_brute(probes, width, k), "probe long, vec_id long, cell int, score double").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).collect()  # k rows a probe
    budget = max(_budget(index, probes, truth, recall), k + 1)

    shared = spark.sparkContext.broadcast((index.first, index.over))  # two numbers a cell

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, over = shared.value
        for b in batches:
            cell, row = b.column(3).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False)
            lane = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % over[cell] if len(cell) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((first[cell] + lane).astype(np.int32))], names=[*b.schema.names, "shard"])

    routed = cut(rows.filter(F.col("vec_id") % every == 0).mapInArrow(_route(index, budget), _entry(rows, "radius double, shard int")))
    parts = routed.groupBy("shard").agg((F.floor((F.count(F.lit(1)) - 1) / PART_QUERIES) + 1).cast("int").alias("parts"))  # a row a shard
    one = placed.mapInArrow(to_shards, _entry(rows, "cell int, shard int")).join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    one = one.select("shard", "part", F.lit(0).alias("kind"), "row", "vec_id", "v", "cell", F.lit(None).cast("double").alias("radius"))
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    many = routed.join(F.broadcast(parts), "shard").select("shard", part.alias("part"), F.lit(1).alias("kind"), "row", "vec_id", "v", F.lit(None).cast("int").alias("cell"), "radius")
    found = one.union(many).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind").mapInArrow(_search(index, k), _FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
