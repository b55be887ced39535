"""A live order book per key from snapshots and numbered diffs.

The levels of a key are map state, so a batch reads and writes one key's book
and no history.  A snapshot replaces the book; the first diff after it must
bridge the snapshot's id, each later one must name the id before it; a size of
zero deletes its level.  A gap fails the key alone, which waits for its next
snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nlargest, nsmallest

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: price and size of each changed level
LEVELS = "array<struct<price:double,size:double>>"
FEATURES = "status string, bid double, bid_size double, ask double, ask_size double, mid double, spread_bps double, microprice double, bid_levels long, ask_levels long, bid_notional double, ask_notional double, imbalance double"
_NAMES = [f.split()[0] for f in FEATURES.split(", ")]


def book_features(bids: dict[float, float], asks: dict[float, float], depth: int) -> tuple:
    """What ``FEATURES`` names but the status; an empty side leaves nulls."""
    b = [(p, bids[p]) for p in nlargest(depth, bids)]
    a = [(p, asks[p]) for p in nsmallest(depth, asks)]
    (bid, bid_size), (ask, ask_size) = b[0] if b else (None, None), a[0] if a else (None, None)
    mid = spread = micro = None
    if b and a:
        mid = (bid + ask) / 2
        spread = (ask - bid) / mid * 1e4 if mid > 0 else None
        micro = (ask * bid_size + bid * ask_size) / (bid_size + ask_size)
    bn, an = sum(p * s for p, s in b), sum(p * s for p, s in a)
    return bid, bid_size, ask, ask_size, mid, spread, micro, len(bids), len(asks), bn, an, (bn - an) / (bn + an) if bn + an > 0 else None


def _levels(cell) -> list[tuple[float, float]]:
    return [] if cell is None else [(float(x["price"]), float(x["size"])) for x in cell if x is not None and x["price"] is not None and x["size"] is not None]


def _number(v) -> int | None:
    return None if v is None or v != v else int(v)


class LiveBook(StatefulProcessor):
    """One row out for each message: its status and the book after it."""

    def __init__(self, key: str, order: str, depth: int) -> None:
        self.key, self.order, self.depth = key, order, depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price double", "size double")
        self.marks = handle.getValueState("marks", "snapshot_id long, last_id long, bridged boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (the base class names them)
        stored = {"bid": {}, "ask": {}}
        for (side, price), (size,) in self.levels.iterator():
            stored[side][price] = size
        book = {side: dict(levels) for side, levels in stored.items()}
        marks = tuple(self.marks.get()) if self.marks.exists() else None
        out = []
        for m in pd.concat(list(rows)).sort_values(self.order, kind="stable").to_dict("records"):
            status, marks = self._apply(book, marks, m)
            seen = book_features(book["bid"], book["ask"], self.depth) if status in ("snapshot", "applied") else (None,) * (len(_NAMES) - 1)
            out.append((key[0], m[self.order], status, *seen))
        for side, levels in book.items():
            for price in stored[side].keys() - levels.keys():
                self.levels.removeKey((side, price))
            for price, size in levels.items():
                if stored[side].get(price) != size:
                    self.levels.updateValue((side, price), (size,))
        if marks is None:
            self.marks.clear()
        else:
            self.marks.update(marks)
        yield pd.DataFrame(out, columns=[self.key, self.order, *_NAMES])

    @staticmethod
    def _apply(book: dict, marks: tuple | None, m: dict) -> tuple[str, tuple | None]:
        first, final, before = (_number(m[c]) for c in ("first_id", "final_id", "prev_id"))
        sides = {"bid": _levels(m["bids"]), "ask": _levels(m["asks"])}
        if m["kind"] == "snapshot":
            whole = final is not None and all(any(s > 0 for _, s in sides[x]) for x in sides)
            for side, levels in sides.items():
                book[side].clear()
                book[side].update({p: s for p, s in levels if s > 0} if whole else {})
            return ("snapshot", (final, final, False)) if whole else ("bad_snapshot", None)
        if first is None or final is None:
            return "ignored", marks
        if marks is None:
            return "gap", None
        snapshot, last, bridged = marks
        if final < snapshot:
            return "old", marks
        if not (before == last if bridged else first <= snapshot <= final):
            for levels in book.values():
                levels.clear()
            return "gap", None
        for side, levels in sides.items():
            for price, size in levels:
                if size > 0:
                    book[side][price] = size
                else:
                    book[side].pop(price, None)
        return "applied", (snapshot, final, True)

    def close(self) -> None:
        pass


def live_book(messages: DataFrame, key: str = "symbol", order: str = "seq", depth: int = 5) -> DataFrame:
    """(key, order, kind, first_id, final_id, prev_id, bids, asks) → key, order
    and ``FEATURES`` for each message, in append mode.

    ``kind`` is 'snapshot', whose id is ``final_id``, or 'diff'.  Status: snapshot,
    applied, old (ends before the snapshot), ignored (has no ids), bad_snapshot
    (no id or an empty side), gap (does not follow, or no book to follow on; the
    book is dropped until the next snapshot).  Within a batch a key's messages
    are taken in ``order``, across batches as they arrive.  Rows without a key
    are dropped.  The session must keep state in RocksDB.
    """
    schema = messages.select(key, order).schema
    for name, kind in (f.split() for f in FEATURES.split(", ")):
        schema = schema.add(name, kind)
    keyed = messages.filter(messages[key].isNotNull()).groupBy(key)
    return keyed.transformWithStateInPandas(LiveBook(key, order, depth), schema, "append", "none")


def rocks(spark):
    """A session of its own on the same cluster that keeps state in RocksDB."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own
