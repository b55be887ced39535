"""Packing token sequences by minimum bin slack over a length histogram.

Documents are cut into full windows and one remainder.  Remainders of equal
length are interchangeable, so the plan needs only how many there are of each
of the at most ``window`` lengths: that histogram is all that reaches the
driver, whatever the size of the corpus.  A bitset subset-sum programme picks
the multiset of remaining lengths that fills a window closest to capacity;
the pattern is used as often as the counts allow before the next is sought.
Each piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import cut

WINDOW = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k"
#: lanes a length at least, and pieces a lane beyond which there are more
LANES, LANE_PIECES = 512, 100_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
_loaded: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """text → ids, equal to those of the tokenizers file of that name with
    add_special_tokens=False, the strings of its added tokens included.  The
    ranks file of the same vocabulary gives the same ids several times faster;
    texts that its pattern engine gives up on (runs of very many blanks) go to
    the tokenizers file itself."""
    if vocabulary not in _loaded:
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        special = {t["content"]: t["id"] for t in added}
        fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if k.decode("utf-8", "replace") not in special}, special_tokens=special)
        held: list = []

        def slow(text: str) -> list[int]:
            from tokenizers import Tokenizer

            if not held:
                held.append(Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
            return held[0].encode(text, add_special_tokens=False).ids

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except BaseException as e:  # a panic of the engine is no Exception, and its class cannot be imported
                if type(e).__name__ != "PanicException":
                    raise
                return slow(text)

        _loaded[vocabulary] = encode if plain else slow
    return _loaded[vocabulary]


def token_pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: windows of exactly ``window`` ids, then the rest."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = encoder(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for doc, text in zip(b.column(0)[at : at + 256].to_pylist(), b.column(1)[at : at + 256].to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    rows += [(doc, s, min(window, len(ids) - s), len(ids), ids[s : s + window].tobytes()) for s in range(0, len(ids), window)]
                names = ["doc_id", "start", "length", "doc_tokens", "ids"]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut_up, PIECES)


def fill_window(counts: Mapping[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum within ``capacity``.

    ``reach[i]`` is the bitset of sums that the first i groups can make; a
    group is a power-of-two number of copies of one length, so that any count
    is a sum of groups.  Backtracking from the best sum gives the counts.
    """
    groups = []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0:
            groups.append((length, min(take, left)))
            left -= take
            take *= 2
    full, reach = (1 << (capacity + 1)) - 1, [1]
    for length, k in groups:
        reach.append(reach[-1] | (reach[-1] << (length * k) & full))
        if reach[-1] >> capacity & 1:
            break
    best = reach[-1].bit_length() - 1
    used: dict[int, int] = {}
    for i in range(len(reach) - 1, 0, -1):
        if not reach[i - 1] >> best & 1:
            length, k = groups[i - 1]
            used[length] = used.get(length, 0) + k
            best -= length * k
    return used


def plan_patterns(histogram: Mapping[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """[(pattern, how often)] that together use up the histogram exactly.

    The longest remaining length opens each window, and the programme fills
    the rest; the number of rounds depends on the number of different lengths
    and not on how many pieces there are.
    """
    left, plan = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = fill_window({k: v for k, v in left.items() if v and k <= window - longest}, window - longest) if longest < window else {}
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((pattern, times))
    return plan


_PLAN = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "first", "last", "per_window", "sequence_base", "offset_base")])


def _plan_rows(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, ...]]:
    rows, given, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n, first = pattern[length], given.get(length, 0)
            rows.append((length, first, first + n * times - 1, n, sequence, offset))
            given[length] = first + n * times
            offset += n * length
        sequence += times
    return rows


def assign(pieces: DataFrame, window: int = WINDOW, lanes: int | None = None) -> DataFrame:
    """Pieces with any columns besides doc_id, start, length → + sequence_id, offset.

    Ranks within a length come from hash lanes, whose number follows that of
    the pieces (counted over what ``pieces`` holds, so give it computed
    already): a row number inside
    (length, lane) plus the counts of the lanes before, so that a length that
    most pieces share is ranked in many tasks.  The plan has at most a few
    rows per length, fixed by ``window``, and is joined on the length.
    """
    spark = pieces.sparkSession
    lanes = lanes or max(LANES, pieces.count() // LANE_PIECES)
    laned = pieces.withColumn("lane", F.pmod(F.xxhash64(F.lit(3), "doc_id", "start"), F.lit(lanes)).cast("int"))
    per_lane = laned.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lane_start = per_lane.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lane_start"))
    histogram = {r["length"]: r["n"] for r in per_lane.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    rows = _plan_rows(plan_patterns(histogram, window))
    plan = spark.createDataFrame(rows, _PLAN)
    inside = Window.partitionBy("length", "lane").orderBy("doc_id", "start")
    ranked = laned.withColumn("rank", F.row_number().over(inside) - 1).join(lane_start, ["length", "lane"])
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("lane_start")).cast("long"))
    # the plan is bounded by the window: under 20 rows for each of 2048 lengths
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & F.col("rank").between(F.col("first"), F.col("last")))
    within = F.col("rank") - F.col("first")
    return placed.select(
        *(ranked[c] for c in pieces.columns),
        (F.col("sequence_base") + F.floor(within / F.col("per_window"))).cast("long").alias("sequence_id"),
        (F.col("offset_base") + F.pmod(within, F.col("per_window")) * ranked["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, window: int = WINDOW, keep: Mapping[str, Column] | None = None, **tokens) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id,
    offset, and the columns ``keep``, computed from the piece's ``ids``
    (little-endian uint32); by default the ids themselves.

    Null and empty texts are the end id alone; a text of any length is encoded
    whole and cut into windows.  Rows that repeat are packed as often as they
    come, null ids like any other.  Further columns are ignored.  An empty
    table gives an empty result.
    """
    keep = {"ids": F.col("ids")} if keep is None else keep
    pieces = token_pieces(docs, window, **tokens).select("doc_id", "start", "length", "doc_tokens", *(c.alias(n) for n, c in keep.items()))
    return assign(cut(pieces), window)

