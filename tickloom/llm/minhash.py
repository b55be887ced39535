"""Buckets, prefixes and exact checks of word-shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: a sketch is 1,024 bits, each the parity of the shingles that fall on it
SKETCH = [f"b{k}" for k in range(16)]
#: shingles that two prefixes have to share
MEET = 4
SIGNED = f"doc_id long, node long, fp long, buckets array<long>, size int, {', '.join(f'{b} long' for b in SKETCH)}, shingles binary"
PREFIX = "token long, node long, size int, left int, indexed boolean"
_RNG = np.random.default_rng(11)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the lower-cased (A-Z) word shingles; a text shorter
    than one shingle is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 3) for g in grams), np.uint64, max(1, len(words) - n + 1)))


def least_values(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(shingles, len(shingles) // 2048 + 1):
        least = np.minimum(least, ((part[:, None] ^ _FLIP) * _TIMES).min(axis=0))
    return least


def bands_of(least: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(least.reshape(BANDS, ROWS))]


def fingerprint_of(shingles: np.ndarray) -> int:
    """64 majority bits of a set of hashes, as a signed long."""
    ones = np.zeros(64, np.int64)
    for part in np.array_split(shingles, len(shingles) // 65536 + 1):
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big", signed=True)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sign(n: int) -> Callable:
    """(doc_id, text) → SIGNED, a few hundred rows a batch."""
    names = [x.split()[0] for x in SIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = [shingle_set(t.as_py(), n) for t in b.column(1)]
                cols = [
                    b.column(0),
                    pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()),
                    pa.array([fingerprint_of(s) for s in sets], pa.int64()),
                    pa.array([bands_of(least_values(s)) for s in sets], pa.list_(pa.int64())),
                    pa.array([len(s) for s in sets], pa.int32()),
                    *map(pa.array, np.array([sketch_of(s) for s in sets], np.int64).reshape(-1, len(SKETCH)).T),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingles) → a row per shingle."""
    for b in batches:
        for s in b.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s.as_buffer(), np.int64))], names=["token"])


def least_overlap(share: float, size: int) -> int:
    """The least whole number that is ``share`` of ``size`` or more."""
    return math.ceil(share * size - 1e-6)


def prefixes(similarity: float, common) -> Callable:
    """(node, shingles) → PREFIX: the first shingles of every set in one order
    of all shingles, the ``common`` ones last.

    Two sets whose similarity suffices share ``MEET`` of these (or all of a
    smaller overlap), and the smaller set (of equals, either) has them among its
    ``indexed`` ones, as otherwise too few are left for the overlap.  ``left``
    counts a set's shingles from this one on.
    ``common`` is a broadcast of the common shingles and their places.
    """
    names = [x.split()[0] for x in PREFIX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = common.value
        for b in batches:
            rows = []
            for node, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(s.as_buffer(), np.uint64)
                n = len(x)
                first, index = (n - least_overlap(share, n) + MEET for share in (similarity, 2 * similarity / (1 + similarity)))
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    x = x[np.argsort(np.where(known[at] == x, place[at], 0), kind="stable")]
                k = np.arange(min(first, n))
                rows.append((x[: len(k)].view(np.int64), np.full(len(k), node), np.full(len(k), n, np.int32), (n - k).astype(np.int32), k < index))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=names)

    return run


def _pairs_where(test: Callable) -> Callable:
    """(a, b, x, y) → the pairs (a, b) whose x and y pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [test(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar(similarity: float) -> Callable:
    """Whole sets with at least this Jaccard similarity."""

    def test(x, y) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if min(len(x), len(y)) < similarity * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (len(x) + len(y) - both)

    return _pairs_where(test)
