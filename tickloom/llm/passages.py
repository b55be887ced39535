"""Passages that repeat across documents, by collinear chaining of seeds.

Seeds are winnowed k-word hashes of whole texts.  Every seed that two or more
documents hold links the first FEW occurrences of each document to the first FEW
in the smallest document, its further ones to the first there, and each further
one there to the first in the largest, so links grow with the seeds and not with
their pairs.  The links of
two documents are chained in order in both, with gap costs, through a Fenwick
tree.  A chain shorter than LONG words is looked at in its surroundings: fewer
words than a passage around it can differ must lie unmatched beside it.  From
every other one each seed that no stretch covers yet starts an alignment word by
word, which extends it to its ends and bridges edits; equal pairs of texts are
aligned once; and what the aligned stretches cover of a document is merged.

Words are runs of anything but the six ASCII blanks, A-Z lower-cased.  A
document is an id with a text: rows that repeat both are one document, and
different texts under one id are different documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import drop, materialise, new_folder, small_batches, written

K = 6
WINNOW = 8
GAP_COST = 0.05
MIN_WORDS = 50
MIN_IDENTITY = 0.8
PAD = 60
#: words that a chain spans without a look at what lies beside it
LONG = 30
#: how far apart matching words beside a short chain may lie, and how many
#: times the share of edits that MIN_IDENTITY allows may lie in MIN_WORDS there
SHIFT, SLACK = 10, 1.5
BATCH_ROWS = 500
#: occurrences in the smallest document that every other document links to
FEW = 4
#: bytes of text that are hashed at once
CHUNK = 1 << 20
_M = 0x9E3779B97F4A7C15
_MIX = np.uint64(_M)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_powers: list[np.ndarray] = []


def _word_hashes(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts laid end to end, and where each text begins → a hash of
    every word, and where the word begins: differences of prefix sums of a
    polynomial, moved to one power and mixed."""
    n = len(data)
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        run = lambda m: np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, m, np.uint64))])
        _powers[:] = [run(_M), run(pow(_M, -1, 1 << 64))]
    blank = _BLANK[data]
    before, after = np.r_[True, blank[:-1]], np.r_[blank[1:], True]
    before[first[first < n]] = True
    after[(first - 1)[(first > 0) & (first <= n)]] = True
    s, e = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_LOWER[data] * _powers[0][:n])])
    h = (total[e + 1] - total[s]) * _powers[1][s]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29)), s


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, words of each text)."""
    hashes, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= CHUNK):
            size += len(texts[upto])
            upto += 1
        part = texts[at:upto]
        if size <= CHUNK:
            first = np.cumsum([0, *map(len, part)])
            h, s = _word_hashes(np.frombuffer(b"".join(part), np.uint8), first)
            hashes.append(h)
            counts[at:upto] = np.diff(np.searchsorted(s, first))
        else:  # one long text, cut at blanks
            text, i = part[0], 0
            while i < len(text):
                j = min(i + CHUNK, len(text))
                while j < len(text) and not _BLANK[text[j]]:
                    j += 1
                h, _ = _word_hashes(np.frombuffer(text, np.uint8, j - i, i), np.array([0]))
                hashes.append(h)
                counts[at] += len(h)
                i = j
        at = upto
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def seeds_of(texts: list[bytes], k: int = K, winnow: int = WINNOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, which text, word positions).  Any ``k + winnow - 1`` words that
    two texts share have a seed in common."""
    w, counts = hashed_words(texts)
    gap = k + winnow
    starts = np.concatenate([[0], np.cumsum(counts + gap)])
    which = np.repeat(np.arange(len(texts)), counts)
    laid = np.zeros(starts[-1] + gap, np.uint64)
    laid[np.arange(len(w)) + which * gap] = w  # texts lie apart, so no gram or window spans two
    n = len(laid) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ laid[j : j + n]) * _MIX
        h ^= h >> np.uint64(29)
    grams = np.maximum(counts - k + 1, 0)
    some = grams > 0
    own = np.zeros(n + 1, np.int32)
    np.add.at(own, starts[:-1][some], 1)
    np.add.at(own, (starts[:-1] + grams)[some], -1)
    h[np.cumsum(own[:-1]) == 0] = np.iinfo(np.uint64).max
    windows = np.maximum(grams - winnow + 1, 1)[some]
    base = np.repeat(starts[:-1][some] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    view = np.lib.stride_tricks.sliding_window_view(h, winnow)
    pick = np.concatenate([b + winnow - 1 - np.argmin(view[b][:, ::-1], axis=1) for b in np.array_split(base, len(base) // 65536 + 1)]) if len(base) else np.empty(0, np.int64)
    at = np.unique(pick)
    # of a run of one gram, as a few words repeated over and over give, one place in winnow words and the last
    again = np.r_[False, (h[at[1:]] == h[at[:-1]]) & (at[1:] - at[:-1] <= winnow)] if len(at) else np.empty(0, bool)
    since = at - at[np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))]
    fresh = np.r_[True, since[1:] // winnow != since[:-1] // winnow][: len(at)] | ~again
    at = at[fresh | ~np.r_[again[1:], False][: len(at)]]
    text = np.searchsorted(starts, at, side="right") - 1
    return h[at].view(np.int64), text, (at - starts[text]).astype(np.int32)


def _texts(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]


def _seed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            h, which, pos = seeds_of(_texts(part.column(2)))
            own = [part.column(i).to_numpy(zero_copy_only=False)[which] for i in (0, 1)]
            # how many places the text has of the seed before this one
            order = np.lexsort((pos, h, which))
            same = np.r_[False, (h[order][1:] == h[order][:-1]) & (which[order][1:] == which[order][:-1])][: len(h)]
            nth = np.empty(len(h), np.int32)
            nth[order] = np.arange(len(h)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(own[0], pa.int64()), pa.array(own[1], pa.int32()), pa.array(pos), pa.array(nth)], names=["h", "doc_id", "ver", "pos", "earlier"])


def chain(d: np.ndarray, a: np.ndarray, k: int = 8, gap_cost: float = GAP_COST) -> list[tuple[int, int, int, int, list[int], list[int]]]:
    """Matches (d, a) → local chains as (d_start, d_end, a_start, a_end, ds, as)
    with the matches of the chain in order; one that continues the exact match
    before it is left out of ds and as.

    The score of a match is k plus the best earlier match, in both orders,
    less the words skipped times ``gap_cost``; with that cost linear, the best
    one is a prefix maximum over ranks of ``a`` in a Fenwick tree.
    """
    order = np.lexsort((a, d))
    d, a = d[order], a[order]
    rank = np.unique(a, return_inverse=True)[1] + 1
    size = int(rank.max())
    tree, owner = [-math.inf] * (size + 1), [-1] * (size + 1)
    score, prev, waiting = [0.0] * len(d), [-1] * len(d), []
    for i in range(len(d)):
        if i and d[i] != d[i - 1]:
            for j in waiting:
                g, r = score[j] + gap_cost * (int(d[j]) + int(a[j])), int(rank[j])
                while r <= size:
                    if g > tree[r]:
                        tree[r], owner[r] = g, j
                    r += r & -r
            waiting = []
        best, by, r = 0.0, -1, int(rank[i]) - 1
        here = gap_cost * (int(d[i]) + int(a[i]))
        while r > 0:
            if tree[r] - here > best:
                best, by = tree[r] - here, owner[r]
            r -= r & -r
        score[i], prev[i] = k + best, by
        waiting.append(i)
    used, out = [False] * len(d), []
    for i in sorted(range(len(d)), key=lambda i: (-score[i], i)):
        last = i
        if used[i]:
            continue
        path = [i]
        while True:
            used[i] = True
            if prev[i] < 0 or used[prev[i]]:
                break
            i = prev[i]
            path.append(i)
        at = [(int(d[x]), int(a[x])) for x in reversed(path)]
        own = [x for n, x in enumerate(at) if not n or x[0] - at[n - 1][0] != x[1] - at[n - 1][1] or x[0] - at[n - 1][0] > k]
        out.append((int(d[i]), int(d[last]) + k, int(a[i]), int(a[last]) + k, [x for x, _ in own], [y for _, y in own]))
    return out


CHAINS = "doc_id long, ver int, d0 long, d1 long, anchor long, aver int, a0 long, a1 long, ds array<long>, as array<long>"


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (doc_id, ver, anchor, aver, pos, apos); a group may
    span batches."""
    names = [x.split()[0] for x in CHAINS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    held = None

    def chains(rows: list[np.ndarray]) -> pa.RecordBatch:
        fresh = np.r_[True, np.any([x[1:] != x[:-1] for x in rows], axis=0)]  # documents that repeat
        doc, ver, anchor, aver, pos, apos = (x[fresh] for x in rows)
        cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (ver[1:] != ver[:-1]) | (anchor[1:] != anchor[:-1]) | (aver[1:] != aver[:-1]), True])
        out = []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out += [(int(doc[s]), int(ver[s]), x[0], x[1], int(anchor[s]), int(aver[s]), *x[2:]) for x in chain(pos[s:e], apos[s:e], K)]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else [[]] * 10, kinds, strict=True)], names=names)

    for b in batches:
        rows = [b.column(i).to_numpy() for i in range(6)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        same = np.all([x == x[-1] for x in rows[:4]], axis=0)
        first = int(np.argmax(same))
        held = [x[first:] for x in rows]
        if first:
            yield chains([x[:first] for x in rows])
    if held is not None and len(held[0]):
        yield chains(held)


def _at_ends(make: Callable[[np.ndarray], Callable[[int, int], tuple]], kinds: list[pa.DataType]) -> Callable:
    """(doc_id, ver, ends, text) → doc_id, ver, s, e and what ``make`` of the
    text's word hashes gives for each (s, e)."""
    names = ["doc_id", "ver", "s", "e", *(f"x{i}" for i in range(len(kinds)))]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        for b in batches:
            for doc, ver, ends, text in zip(*(b.column(i) for i in range(3)), _texts(b.column(3)), strict=True):
                doc, ver, of = doc.as_py(), ver.as_py(), make(hashed_words([text])[0])
                for x in ends.as_py():
                    rows.append((doc, ver, x["s"], x["e"], *of(x["s"], x["e"])))
                    if len(rows) == BATCH_ROWS:
                        yield batch()
        if rows:
            yield batch()

    return run


def _beside(reach: int) -> Callable:
    """A byte for each of the ``reach`` words before s, the nearest first, and
    after e; 0 beyond the text."""

    def make(w: np.ndarray) -> Callable[[int, int], tuple]:
        b = np.concatenate([np.zeros(reach, np.uint8), np.maximum((w >> np.uint64(56)).astype(np.uint8), 1), np.zeros(reach, np.uint8)])
        return lambda s, e: (b[s : s + reach][::-1].tobytes() + b[e + reach : e + 2 * reach].tobytes(),)

    return make


def _slice(w: np.ndarray) -> Callable[[int, int], tuple]:
    """The words from PAD before s to PAD after e, and a hash of them."""
    small = (w >> np.uint64(32)).astype(np.uint32)

    def of(s: int, e: int) -> tuple:
        own = small[max(0, s - PAD) : e + PAD].tobytes()
        return xxhash.xxh3_128_digest(own), own

    return of


def _unmatched(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the first 0, 1, 2, ... words of each row of x have no equal
    within SHIFT places in y; words beyond a text count as many."""
    found = np.zeros(x.shape, bool)
    n = x.shape[1]
    for o in range(-min(SHIFT, n), min(SHIFT, n) + 1):
        i, j = max(0, -o), n - max(0, o)
        found[:, i:j] |= x[:, i:j] == y[:, i + o : j + o]
    cost = np.where(x == 0, 1000, ~found)
    return np.concatenate([np.zeros((len(x), 1), int), np.cumsum(cost, axis=1)], axis=1)


def fits(x: np.ndarray, y: np.ndarray, span: np.ndarray, min_words: int, most: int) -> np.ndarray:
    """Whether ``min_words`` words of x around a chain of ``span`` words can lie
    in a passage: at most ``most`` of those beside it have no match."""
    reach = x.shape[1] // 2
    left, right = _unmatched(x[:, :reach], y[:, :reach]), _unmatched(x[:, reach:], y[:, reach:])
    out = np.zeros(len(x), bool)
    for n in np.unique(span):
        need, rows = min(reach, max(0, min_words - int(n))), span == n
        out[rows] = (left[rows, : need + 1] + right[rows, need::-1][:, : need + 1]).min(axis=1) <= most
    return out


def _fit_batches(min_words: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (10, 11))
                span = np.maximum(b.column(3).to_numpy() - b.column(2).to_numpy(), b.column(7).to_numpy() - b.column(6).to_numpy())
                keep = fits(x, y, span, min_words, most)
                yield pa.RecordBatch.from_arrays(b.columns[:10], names=b.schema.names[:10]).filter(pa.array(keep))

    return run


def extend(x: list[int], y: list[int], i: int, j: int, drop: int = 8, reach: int = 12, cost: float = 1) -> tuple[int, int, int]:
    """Align x[i:] with y[j:] from a common start: (end in x, end in y, words
    matched).  Edits are bridged by the nearest two words in step; the walk
    ends where the score, one up a match and ``cost`` down an edit, has dropped
    by ``drop`` edits."""
    drop *= cost
    score = best = same = 0
    end = (i, j, 0)
    while i < len(x) and j < len(y) and score > best - drop:
        while x[i : i + 64] == y[j : j + 64] and i + 64 <= len(x) and j + 64 <= len(y):
            i, j, same, score = i + 64, j + 64, same + 64, score + 64
        if score > best:
            best, end = score, (i, j, same)
        if i == len(x) or j == len(y):
            break
        if x[i] == y[j]:
            i, j, same, score = i + 1, j + 1, same + 1, score + 1
            if score > best:
                best, end = score, (i, j, same)
            continue
        ahead: dict[tuple[int, int], int] = {}
        for p in range(min(reach, len(x) - i - 1)):
            ahead.setdefault((x[i + p], x[i + p + 1]), p)
        step = (1, 1)
        best_skip = reach
        for q in range(min(reach, len(y) - j - 1)):
            p = ahead.get((y[j + q], y[j + q + 1]))
            if p is not None and p + q < best_skip:
                best_skip, step = p + q, (p, q)
        i, j, score = i + step[0], j + step[1], score - cost * max(step)
    return end


def align(x: list[int], y: list[int], i: int, j: int, min_identity: float = MIN_IDENTITY, x_from: int = 0, y_from: int = 0) -> tuple[int, int, int, int, int]:
    """Both ways from the common seed at x[i], y[j]: spans in x and y, matches.
    Where that is less alike than ``min_identity``, an edit costs as many
    matches as hold the identity at every end the walk can take."""
    for cost in (1, min_identity / max(1 - min_identity, 1e-9)):
        xe, ye, right = extend(x, y, i, j, cost=cost)
        xb, yb, left = extend(x[x_from:i][::-1], y[y_from:j][::-1], 0, 0, cost=cost)
        out = i - xb, xe, j - yb, ye, left + right
        if _alike(*out, min_identity):
            break
    return out


def _alike(xb: int, xe: int, yb: int, ye: int, same: int, min_identity: float) -> bool:
    return same >= min_identity * max(xe - xb, ye - yb) - 1e-9


def stretches(x: list[int], y: list[int], seeds: list[tuple[int, int]], k: int = K, min_identity: float = MIN_IDENTITY) -> list[tuple[int, int, int, int, int]]:
    """All that a chain of seeds aligns, as from ``align``: a stretch from each
    seed that the last one does not cover, and neighbouring stretches as one
    where they stay alike with the words between them."""
    out, parts = [], []
    for i, j in seeds:
        if out and i + k <= out[-1][1] and j + k <= out[-1][3]:
            continue
        out.append(align(x, y, i, j, min_identity))
        part = out[-1]
        if parts and (part[0] < parts[-1][1] or part[2] < parts[-1][3]):
            if i < parts[-1][1] or j < parts[-1][3]:
                continue
            part = align(x, y, i, j, min_identity, parts[-1][1], parts[-1][3])
        parts.append(part)
    matched = np.cumsum([0] + [p[4] for p in parts]).tolist()
    s = 0
    while s < len(parts):
        e = len(parts) - 1
        while e > s and not _alike(parts[s][0], parts[e][1], parts[s][2], parts[e][3], matched[e + 1] - matched[s], min_identity):
            e -= 1
        if e > s:
            out.append((parts[s][0], parts[e][1], parts[s][2], parts[e][3], matched[e + 1] - matched[s]))
        s = e + 1
    return out


def _align_batches(min_identity: float) -> Callable:
    """(pair, rs, rt, x, y) → aligned stretches, in words from the slices' starts."""
    names = ["pair", "xb", "xe", "yb", "ye", "matched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pair, rs, rt, x, y in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), b.column(4), strict=True):
                x, y = (np.frombuffer(t.as_buffer(), np.uint32).tolist() for t in (x, y))
                out += [(pair, *row) for row in stretches(x, y, list(zip(rs, rt, strict=True)), K, min_identity)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

    return run


def shared_pairs(docs: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """Aligned passages of pairs: doc_id, ver, start, end, partner, pver,
    p_start, p_end, matched; positions count words from 0, ends exclusive; ver
    tells texts of one id apart."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "passages")
    own = small_batches(spark, BATCH_ROWS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("ver"), "text").filter("doc_id is not null and text is not null")

    def table(df: DataFrame, name: str, session=None) -> DataFrame:
        path = written(df, folder, name)
        return (session or spark).read.schema(df.schema).parquet(path)

    # tables that are written before a join read plain exchanges there, which Spark splits at a hot key
    seeds = table(docs.mapInArrow(_seed_batches, "h long, doc_id long, ver int, pos int, earlier int"), "seeds")
    repeated = seeds.groupBy("h").agg(F.min("doc_id").alias("anchor"), F.max("doc_id").alias("last"), F.min("ver").alias("v0"), F.max("ver").alias("v1"))
    repeated = table(repeated.filter("anchor < last or v0 < v1").select("h", "anchor"), "repeated")
    held = table(seeds.join(repeated, "h"), "held")
    drop(spark, f"{folder}/seeds")
    mine = held.filter("doc_id = anchor").select("h", F.col("ver").alias("aver"), F.col("pos").alias("apos")).distinct()
    by_place = Window.partitionBy("h").orderBy("aver", "apos")
    mine = mine.withColumn("nth", F.row_number().over(by_place)).withColumn("least", F.first("aver").over(by_place))
    at = table(mine.filter("aver = least").drop("least"), "at")
    pair = ["doc_id", "ver", "anchor", "aver", "pos", "apos"]
    other = "doc_id != anchor or ver != aver"
    links = held.join(at.filter(F.col("nth") <= FEW), "h").filter(other).filter((F.col("earlier") < FEW) | (F.col("nth") == 1)).select(*pair)
    # the anchor's further occurrences link to one place of one document each
    more = at.filter(F.col("nth") > FEW)
    # the largest document of a seed that two hold is never its anchor
    place = held.groupBy("h", "anchor").agg(F.max(F.struct("doc_id", "ver", (-F.col("pos")).alias("back"))).alias("m"))
    place = table(place.join(at.filter(F.col("nth") == FEW + 1).select("h", "aver"), "h"), "place")
    further = place.drop("aver").join(more, "h").select("m.doc_id", "m.ver", "anchor", "aver", (-F.col("m.back")).alias("pos"), "apos")
    chained = links.union(further).repartition("doc_id", "ver", "anchor", "aver").sortWithinPartitions(*pair)
    found = table(chained.mapInArrow(_chain_batches, CHAINS), "found")
    for name in ("repeated", "held", "at", "place"):
        drop(spark, f"{folder}/{name}")

    def sides(chains: DataFrame) -> DataFrame:
        ends = chains.select("doc_id", "ver", F.col("d0").alias("s"), F.col("d1").alias("e")).union(chains.select("anchor", "aver", "a0", "a1")).distinct()
        # a text is read once for all its ends in a few thousand words
        ends = ends.groupBy("doc_id", "ver", F.expr("s div 4096").alias("part")).agg(F.collect_list(F.struct("s", "e")).alias("ends"))
        return docs.join(ends.hint("merge"), ["doc_id", "ver"]).select("doc_id", "ver", "ends", "text")

    keys = ["doc_id", "ver", "s", "e"]

    def at_both(chains: DataFrame, what: DataFrame, columns: list[str]) -> DataFrame:
        """Chains with the columns of ``what`` at their two places."""
        left = what.select(F.col("doc_id"), F.col("ver"), F.col("s").alias("d0"), F.col("e").alias("d1"), *(F.col(c).alias(f"l{c}") for c in columns))
        right = what.select(F.col("doc_id").alias("anchor"), F.col("ver").alias("aver"), F.col("s").alias("a0"), F.col("e").alias("a1"), *(F.col(c).alias(f"r{c}") for c in columns))
        both = chains.join(left.hint("merge"), ["doc_id", "ver", "d0", "d1"]).join(right.hint("merge"), ["anchor", "aver", "a0", "a1"])
        return both.select(*found.columns, *(f"l{c}" for c in columns), *(f"r{c}" for c in columns))

    reach = max(1, min_words - K)
    span = F.greatest(F.col("d1") - F.col("d0"), F.col("a1") - F.col("a0"))
    beside = sides(found.filter(span < LONG)).mapInArrow(_at_ends(_beside(reach), [pa.binary()]), "doc_id long, ver int, s long, e long, x0 binary")
    beside = table(beside.dropDuplicates(keys), "beside")
    most = int(SLACK * (1 - min_identity) * min_words + 1e-9)
    fit = table(at_both(found.filter(span < LONG), beside, ["x0"]).mapInArrow(_fit_batches(min_words, most), CHAINS), "fit")
    found = table(found.filter(span >= LONG).union(fit), "whole")
    drop(spark, f"{folder}/beside")
    sliced = sides(found).mapInArrow(_at_ends(_slice, [pa.binary(), pa.binary()]), "doc_id long, ver int, s long, e long, x0 binary, x1 binary")
    sliced = table(sliced.dropDuplicates(keys), "sliced")
    words = table(sliced.groupBy("x0").agg(F.first("x1").alias("words")), "words")
    moved = lambda c, start: F.transform(c, lambda v: v - F.greatest(start - PAD, F.lit(0)))
    named = at_both(found, sliced.drop("x1"), ["x0"]).withColumn("rs", moved(F.col("ds"), F.col("d0"))).withColumn("rt", moved(F.col("as"), F.col("a0")))
    told = F.concat_ws(":", F.hex("lx0"), F.hex("rx0"), F.array_join("rs", ","), F.array_join("rt", ","))
    named = table(named.withColumn("pair", F.unhex(F.sha2(told, 256))).select("pair", "lx0", "rx0", "rs", "rt", "doc_id", "ver", "d0", "anchor", "aver", "a0"), "named")
    once = table(named.groupBy("pair").agg(*(F.first(c).alias(c) for c in ("lx0", "rx0", "rs", "rt"))), "once")
    reopened = lambda name, kind: own.read.schema(kind.schema).parquet(f"{folder}/{name}")
    text = reopened("words", words)
    both = reopened("once", once).join(text.select(F.col("x0").alias("lx0"), F.col("words").alias("x")).hint("merge"), "lx0").join(text.select(F.col("x0").alias("rx0"), F.col("words").alias("y")).hint("merge"), "rx0")
    aligned = both.select("pair", "rs", "rt", "x", "y").mapInArrow(_align_batches(min_identity), "pair binary, xb long, xe long, yb long, ye long, matched long")
    alike = (F.col("matched") >= K) & (F.col("matched") >= min_identity * F.greatest(F.col("xe") - F.col("xb"), F.col("ye") - F.col("yb")))
    written(aligned.filter(alike), folder, "aligned")
    aligned = spark.read.schema(aligned.schema).parquet(f"{folder}/aligned")
    x0, y0 = F.greatest(F.col("d0") - PAD, F.lit(0)), F.greatest(F.col("a0") - PAD, F.lit(0))
    out = materialise(
        named.join(aligned.hint("merge"), "pair").select(
            "doc_id", "ver", (F.col("xb") + x0).alias("start"), (F.col("xe") + x0).alias("end"),
            F.col("anchor").alias("partner"), F.col("aver").alias("pver"), (F.col("yb") + y0).alias("p_start"), (F.col("ye") + y0).alias("p_end"), "matched",
        )
    )
    drop(spark, folder)
    return out


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """One row per passage of ``min_words`` or more that other documents hold:
    doc_id, start, end, words, partner_id, n_links.

    A passage is a stretch that aligned passages cover without a break; the
    partner is the smallest document linked to it, n_links the number of
    different aligned stretches in it.  Documents without one are not listed.
    Null ids and texts take no part, nor do repeats inside one document or of
    a whole row; different texts of one id are documents of their own, listed
    under that id.  Texts of any length are read whole; further columns are
    ignored; an empty table gives an empty result.
    """
    pairs = shared_pairs(docs, min_words, min_identity)
    sides = pairs.select("doc_id", "ver", "start", "end", "partner").union(pairs.select("partner", "pver", "p_start", "p_end", "doc_id"))
    spans = sides.groupBy("doc_id", "ver", "start", "end").agg(F.min("partner").alias("partner"))
    # spans of one start reduce to the longest before any document is gathered
    spans = spans.groupBy("doc_id", "ver", "start").agg(F.max("end").alias("end"), F.min("partner").alias("partner"), F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy("doc_id", "ver").orderBy("start")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(earlier), F.lit(True)).cast("int"))
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    merged = marked.withColumn("part", F.sum("fresh").over(upto)).groupBy("doc_id", "ver", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("partner").alias("partner_id"), F.sum("n").alias("n_links"))
    return merged.withColumn("words", F.col("end") - F.col("start")).filter(F.col("words") >= min_words).select("doc_id", "start", "end", "words", "partner_id", "n_links")
