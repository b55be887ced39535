"""Whitening of embeddings through the exact characteristic polynomial.

Vectors become integers, so that the scatter matrix of the distinct ones,
n * sum(x x') - S S' (n squared times their covariance), is exact.  Its
characteristic polynomial is found modulo many primes, a prime a row, by
Hessenberg reduction, and put together by Chinese remaindering.  All its roots
are real and none is negative, so the sign changes of a Taylor shift count the
roots beyond a point exactly; halving isolates the largest ones and goes on to
``ROOT_BITS`` bits.  A root's component comes from inverse iteration on the
null space in fixed-point arithmetic of ``WORK_BITS`` bits, a root a row.

What reaches the driver hangs on the number of dimensions alone: the sums, the
scatter matrix, its polynomial modulo each prime, and the components.  Work on
the polynomial grows with the fourth power of the dimensions; some hundreds are
in reach.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import materialise

SCALE = 64
#: scaled components beyond are held there, so that sums of products stay exact
REACH = 2**40
COMPONENTS = 16
ROOT_BITS, WORK_BITS = 100, 320
_MOMENT = "i int, j int, v decimal(38,0)"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and holds no null or non-finite entry."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.filter(x.isNotNull() & ~F.coalesce(bad, F.lit(True)))


def _scaled(column: str):
    return F.transform(column, lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(float(REACH))), F.lit(-float(REACH)))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _top(m: np.ndarray) -> int:
    return max(int(m.max()), -int(m.min())) if m.size else 0


# -- the scatter matrix -------------------------------------------------------


def _moments(width: int) -> Callable:
    """Per task: the products (i, j >= i), the sums (i, -1) and the count (-1, -1)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            u = _matrix(batch.column(0), width).astype(np.int64)
            small = max(_top(u), 1) ** 2 < 2**53
            step = max(1, (2**53 - 1) // max(_top(u), 1) ** 2) if small else len(u)
            for start in range(0, len(u), step):  # as many rows as doubles add up exactly
                part = u[start : start + step].astype(float if small else object)
                n, sums, products = n + len(part), sums + part.sum(axis=0).astype(object), products + (part.T @ part).astype(object)
        a, b = np.triu_indices(width)
        i, j = np.concatenate([a, np.arange(width), [-1]]), np.concatenate([b, np.full(width, -1), [-1]])
        v = [Decimal(int(x)) for x in [*products[a, b], *sums, n]]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.decimal128(38, 0))], names=["i", "j", "v"])

    return moments


def _scatter(distinct: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and scatter matrix of the distinct vectors, exact."""
    rows = distinct.mapInArrow(_moments(width), _MOMENT).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # a row a pair of dimensions
    v = {(r.i, r.j): int(r.v) for r in rows}
    n, sums = v.get((-1, -1), 0), [v.get((i, -1), 0) for i in range(width)]
    return n, sums, [[n * v[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(width)] for i in range(width)] if n else []


# -- its characteristic polynomial --------------------------------------------


def _primes(bits: int) -> list[int]:
    """Primes below 2^31 from the top whose product has more than ``bits`` bits,
    and one more."""
    sieve = np.ones(46341, bool)
    for q in range(2, 216):
        sieve[q * q :: q] = False
    small = [int(q) for q in np.flatnonzero(sieve) if q > 2]
    found: list[int] = []
    top = 2**31 - 1
    while True:
        odd = np.arange(top, top - (1 << 16), -2)
        prime = np.ones(len(odd), bool)
        for q in small:
            prime[top * (q + 1) // 2 % q :: q] = False  # where top - 2k is divisible by q
        for p in odd[prime]:
            found.append(int(p))
            if 30 * (len(found) - 1) > bits + 1:
                return found
        top = int(odd[-1]) - 2


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, lowest first, of det(x - matrix) modulo the prime ``p``."""
    h, d = matrix % p, len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        r = k + 1 + int(below[0])
        if r != k + 1:
            h[[r, k + 1]] = h[[k + 1, r]]
            h[:, [r, k + 1]] = h[:, [k + 1, r]]
        m = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - m[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * m % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks
    poly[0, 0] = 1
    for k in range(d):
        now = np.roll(poly[k], 1)
        now = (now - h[k, k] * poly[k]) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            now = (now - int(h[i, k]) * chain % p * poly[i]) % p
        poly[k + 1] = now
    return poly[d]


def _remainders(matrix: list[list[int]]) -> Callable:
    def remainders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        big = np.array(matrix, object)
        for f in frames:
            yield pd.DataFrame({"p": f["p"], "c": [polynomial_mod((big % int(p)).astype(np.int64), int(p)).tolist() for p in f["p"]]})

    return remainders


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, lowest first, of an integer matrix that is symmetric and
    has no negative eigenvalue; a prime too many checks the result."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # the kth elementary symmetric function of d numbers that add up to the trace
    bits = max((math.comb(d, k) * trace**k // d**k).bit_length() for k in range(d + 1))
    primes = _primes(bits)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 256)).mapInPandas(_remainders(matrix), "p long, c array<long>").collect()
    found = {r.p: r.c for r in rows}
    whole, modulus = np.zeros(d + 1, object), 1
    for p in primes[:-1]:
        step = (np.array(found[p], object) - whole) * pow(modulus, -1, p) % p
        whole, modulus = whole + step * modulus, modulus * p
    whole = np.where(whole > modulus // 2, whole - modulus, whole)
    if any((int(c) - r) % primes[-1] for c, r in zip(whole, found[primes[-1]], strict=True)):
        raise ArithmeticError("the check prime contradicts the polynomial")
    return [int(c) for c in whole]


# -- its roots ----------------------------------------------------------------


@dataclass(frozen=True)
class Root:
    """A root in (k, k + 1] / 2^s, or so many that are equal to all its bits."""

    k: int
    s: int
    times: int

    @property
    def value(self) -> Fraction:
        return Fraction(2 * self.k + 1) / Fraction(2) ** (self.s + 1)


def _at(poly: list[int], k: int, s: int) -> tuple[list[int], int]:
    """The polynomial of x * 2^s for s > 0, and the point k / 2^s in its terms."""
    d = len(poly) - 1
    return ([c << (s * (d - i)) for i, c in enumerate(poly)], k) if s > 0 else (poly, k << -s)


def roots_beyond(poly: list[int], k: int, s: int) -> int:
    """How many roots, all real, exceed k / 2^s: the sign changes of the shifted
    polynomial (Descartes' bound is exact where all roots are real)."""
    c, a = _at(poly, k, s)
    c = list(c)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], k: int, s: int) -> int:
    c, a = _at(poly, k, s)
    total = 0
    for x in reversed(c):
        total = total * a + x
    return (total > 0) - (total < 0)


def largest_roots(poly: list[int], bound: int, want: int, bits: int = ROOT_BITS) -> list[Root]:
    """The ``want`` largest positive roots, none above ``bound``, each to
    ``bits`` bits, the largest first."""
    found: list[Root] = []
    todo = [(0, -bound.bit_length(), roots_beyond(poly, 0, 0), 0)]  # roots beyond either end
    while todo and sum(r.times for r in found) < want:
        k, s, low, high = todo.pop()
        if low == high:
            continue
        if k >> bits:
            found.append(Root(k, s, low - high))
            continue
        middle = 2 * k + 1
        if low - high == 1:  # the sign tells on which side of the middle it lies
            sign = _sign(poly, middle, s + 1)
            beyond = high if sign == 0 or sign == (-1) ** high else low
        else:
            beyond = roots_beyond(poly, middle, s + 1)
        todo += [(2 * k, s + 1, low, beyond), (middle, s + 1, beyond, high)]
    return found


# -- the components -----------------------------------------------------------


def null_vectors(matrix: list[list[int]], root: Root, bits: int = WORK_BITS) -> list[np.ndarray]:
    """Orthonormal vectors that ``matrix - root`` sends to nearly nothing, as
    doubles, by inverse iteration in fixed-point numbers of ``bits`` bits."""
    d, value = len(matrix), root.value
    size = max(sum(matrix[i][i] for i in range(d)), 1)
    m = np.array([[(x << bits) // size for x in row] for row in matrix], object)
    shift = (value.numerator << bits) // (value.denominator * size)
    for i in range(d):
        m[i, i] -= shift
    steps = []
    for k in range(d):
        r = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
        if r != k:
            m[[k, r]] = m[[r, k]]
        if m[k, k] == 0:
            m[k, k] = 1  # the last place
        f = (m[k + 1 :, k] << bits) // m[k, k]
        m[k + 1 :, k:] -= (f[:, None] * m[k, k:]) >> bits
        steps.append((r, f))

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for k, (r, f) in enumerate(steps):
            y[[k, r]] = y[[r, k]]
            y[k + 1 :] -= (f * y[k]) >> bits
        for k in range(d - 1, -1, -1):
            y[k] = ((y[k] - ((m[k, k + 1 :] * y[k + 1 :]).sum() >> bits)) << bits) // m[k, k]
        return y

    def unit(y: np.ndarray) -> np.ndarray:
        top = max(abs(int(x)) for x in y)
        y = np.array([(int(x) << bits) // top for x in y], object)
        norm = math.isqrt(sum(int(x) * int(x) for x in y))
        return np.array([(int(x) << bits) // norm for x in y], object)

    found: list[np.ndarray] = []
    rng = np.random.default_rng(0)
    for _ in range(root.times):
        y = np.array([int(x) << (bits - 20) for x in rng.integers(1, 1 << 20, d)], object)
        for _ in range(3):
            for other in (*found, *found):  # twice is enough
                y = y - ((((y * other).sum() >> bits) * other) >> bits)
            y = unit(solve(unit(y)))
        for other in (*found, *found):
            y = y - ((((y * other).sum() >> bits) * other) >> bits)
        found.append(unit(y))
    out = [np.array([float(Fraction(int(x), 1 << bits)) for x in y]) for y in found]
    return [y if y[np.argmax(np.abs(y))] > 0 else -y for y in out]


def _components(matrix: list[list[int]]) -> Callable:
    def components(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(int(at) + i, y.tolist()) for at, k, s, times in zip(f["at"], f["k"], f["s"], f["times"], strict=True) for i, y in enumerate(null_vectors(matrix, Root(int(k), int(s), int(times))))]
            yield pd.DataFrame(rows, columns=["component", "y"])

    return components


# -- the operator -------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What a fit knows.  ``kind`` is the smallest type that holds every scaled
    entry of the fitted table."""

    width: int
    kind: str
    n: int = 0
    sums: list[int] = field(default_factory=list)
    trace: int = 0
    values: list[Fraction] = field(default_factory=list)  # of the scatter matrix
    components: np.ndarray | None = None  # a row a component

    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]

    def projection(self) -> np.ndarray:
        """Dimensions × components: from x - S/n to whitened coordinates."""
        return (self.components / np.sqrt([float(v / self.n**2) for v in self.values])[:, None]).T


def _coded(vectors: DataFrame, width: int, kind: str, column: str) -> DataFrame:
    """Usable rows with u = floor(64 c), filled up with zeros to the width; the
    constant that x adds to u drops out of every difference."""
    u = _scaled(column)
    return usable(vectors, column).withColumn(column, F.slice(F.concat(u, F.array_repeat(F.lit(0).cast("long"), width)), 1, width).cast(f"array<{kind}>"))


def _kind(top: int) -> str:
    return next(k for k, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if top < 2**bits)


def fit(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> tuple[Whitening, DataFrame]:
    """The whitening of ``vectors`` and its fit list: each distinct vector of
    integers once.

    Components whose eigenvalue is 0 are left out, as nothing can be divided by
    it; a table without two distinct vectors has none.  Vectors of unequal
    length are filled up with zeros.
    """
    spark = vectors.sparkSession
    extent = usable(vectors, column).agg(F.max(F.size(column)).alias("width"), F.max(F.array_max(F.transform(_scaled(column), F.abs))).alias("top")).first()
    width, kind = extent.width or 0, _kind(extent.top or 0)
    distinct = materialise(_coded(vectors, width, kind, column).select(F.col(column).alias("u")).distinct())
    if not width:
        return Whitening(width, kind), distinct
    n, sums, scatter = _scatter(distinct, width)
    divisor = math.gcd(*(x for row in scatter for x in row)) if n else 0
    if not divisor:
        return Whitening(width, kind, n, sums), distinct
    small = [[x // divisor for x in row] for row in scatter]
    trace = sum(small[i][i] for i in range(width))
    roots = largest_roots(characteristic_polynomial(spark, small), trace, components)
    first = np.cumsum([0, *(r.times for r in roots)])
    # the position of a root has over 64 bits, so it goes as text
    asked = spark.createDataFrame([(int(at), str(r.k), r.s, r.times) for at, r in zip(first, roots, strict=False)], "at int, k string, s int, times int")
    rows = asked.repartition(max(len(roots), 1)).mapInPandas(_components(small), "component int, y array<double>").collect()  # at most a row a dimension
    found = np.array([y for _, y in sorted((r.component, r.y) for r in rows)])[:components]
    values = [r.value * divisor for r in roots for _ in range(r.times)][:components]
    return Whitening(width, kind, n, sums, trace * divisor, values, found), distinct


def _project(w: Whitening, at: int, names: list[str]) -> Callable:
    sums, to = w.sums, w.projection()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _matrix(batch.column(at), w.width)
            reach = w.n * _top(u) + max((abs(s) for s in sums), default=0)
            exact = np.int64 if reach**2 * w.width < 2**63 else object
            away = u.astype(exact) * w.n - np.array(sums, exact)
            deviation = [min(int(x), 2**63 - 1) for x in (away * away).sum(axis=1)]
            z = (away / w.n).astype(float) @ to
            ends = pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32())
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], names=names)

    return project


def apply(w: Whitening, vectors: DataFrame, keys: list[str], column: str = "embedding") -> DataFrame:
    """``keys``, deviation and whitened (an array) of every usable row.

    ``deviation`` is exact, held at the largest long if it is beyond."""
    coded = _coded(vectors.select(*keys, column), w.width, w.kind, column)
    kinds = ", ".join(f"`{k}` {coded.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "deviation", "whitened"]
    return coded.mapInArrow(_project(w, len(keys), names), f"{kinds}{', ' if keys else ''}deviation long, whitened array<double>")


def _cells(w: Whitening, mean: np.ndarray | None) -> Callable:
    """Per task: the sums of the whitened fit list or, given its mean, of the
    products of what is left of it."""
    project = _project(w, 0, ["deviation", "whitened"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(w.values)
        total = np.zeros((c, c) if mean is not None else (1, c))
        for b in project(batches):
            z = _matrix(b.column(1), c)
            total += z.sum(axis=0) if mean is None else (z - mean).T @ (z - mean)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    return cells


def identity_error(w: Whitening, distinct: DataFrame) -> float:
    """The largest entry, by size, of the whitened fit list's covariance minus
    the identity."""

    def summed(mean):
        rows = distinct.mapInArrow(_cells(w, mean), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # a row a pair of components
        return {(r.i, r.j): r.v / w.n for r in rows}

    mean = summed(None)
    covariance = summed(np.array([mean[0, j] for j in range(len(w.values))]))
    return max(abs(v - (i == j)) for (i, j), v in covariance.items())


def digest(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for
    every usable row and component.

    Rows that share an id or a vector are returned as often as they come, null
    ids like any other; further columns are ignored; an empty table, and one
    whose usable vectors are all equal, gives an empty result.
    """
    w, distinct = fit(vectors, components)
    if not w.values:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = apply(w, vectors.withColumn("vec_id", F.col("vec_id").cast("long")), ["vec_id"])
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, w.explained())), F.col("at") + 1)
    return long.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(identity_error(w, distinct)).alias("identity_error"))
