"""Fill-in-the-middle rewriting of whole texts by displacement scatter.

A document is cut into prefix, middle and suffix at line borders.  The texts of
a batch lie in one byte buffer; one scan finds lines, sentinels and cuts, and
the shift from a byte's place to its place in the output is constant over a
segment.  So a difference array over the batch, with an entry where a segment
starts, sums up to every byte's shift, and one scatter writes all outputs.
``restore`` finds the sentinels of each output, sums up the same shifts and
gathers the texts back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import own_name

#: fixed values of the output format
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = len(PREFIX)
FORMS = ("plain", "psm", "spm")
SEED = 7
#: bytes that one pass of the scatter takes (a longer text is a pass of its own)
PASS_BYTES = 4 << 20


def draws(key: str = "doc_id", seed: int = SEED) -> list:
    """h1 to h4: 32-bit numbers from the SHA-256 of ``seed:key``, native; a null
    key draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one buffer and the borders of its rows;
    nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _marks(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and middle byte of every sentinel that lies in one row."""
    at = np.flatnonzero(buf == PREFIX[0])
    at = at[at + MARK <= len(buf)]
    kind = buf[at + 1]
    ok = (buf[at + 2] == PREFIX[2]) & ((kind == PREFIX[1]) | (kind == SUFFIX[1]) | (kind == MIDDLE[1]))
    at, kind = at[ok], kind[ok]
    row = np.searchsorted(ends, at, side="right") - 1
    inside = at + MARK <= ends[row + 1]
    return row[inside], at[inside], kind[inside]


def _shifts(size: int, starts: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Every byte's shift from those of the segments, which lie side by side;
    an empty segment's entry cancels out with its neighbour's."""
    diff = np.zeros(size + 1, np.int64)
    np.add.at(diff, starts, np.diff(shift, prepend=0))
    return np.cumsum(diff[:size])


def _cut(buf: np.ndarray, ends: np.ndarray, h: np.ndarray, rate: int, spm: int) -> dict[str, np.ndarray]:
    """Per row: number of lines, form (its place in ``FORMS``) and the two cuts."""
    lo, hi = ends[:-1], ends[1:]
    line_end = np.flatnonzero(buf == 10) + 1
    first = np.searchsorted(line_end, lo, side="right")
    breaks = np.searchsorted(line_end, hi, side="right") - first
    full = hi > lo
    tail = full & (buf[np.maximum(hi - 1, 0)] != 10) if len(buf) else np.zeros(len(lo), bool)
    n = breaks + tail
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    a, b = np.minimum(a, b), np.maximum(a, b)

    def border(k):  # the end of the kth line of each row
        inner = (k > 0) & (k <= breaks)
        out = np.where(k > 0, hi, lo)
        out[inner] = line_end[(first + k - 1)[inner]]
        return out

    form = np.where(h[3] % 100 < spm, 2, 1)
    form[~full | (h[2] % 100 >= rate)] = 0
    form[_marks(buf, ends)[0]] = 0
    return {"n": n, "form": form, "a": border(a), "b": border(b)}


def scatter(buf: np.ndarray, ends: np.ndarray, form: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of all rows in one buffer, and their borders."""
    lo, hi, size = ends[:-1], ends[1:], np.diff(ends)
    out_ends = np.concatenate([[0], np.cumsum(size + 3 * MARK * (form > 0))])
    base, suffix = out_ends[:-1], hi - b
    # the place of each segment in the output, in the order of the input
    to_prefix = np.choose(form, [base, base + MARK, base + 2 * MARK + suffix])
    to_middle = np.where(form > 0, base + 3 * MARK + (a - lo) + suffix, base + (a - lo))
    to_suffix = np.choose(form, [base + (b - lo), base + 2 * MARK + (a - lo), base + MARK])
    starts = np.stack([lo, a, b], 1).ravel()
    shift = np.stack([to_prefix - lo, to_middle - a, to_suffix - b], 1).ravel()
    out = np.empty(out_ends[-1], np.uint8)
    out[np.arange(len(buf)) + _shifts(len(buf), starts, shift)] = buf
    cut = form > 0
    for mark, place in ((PREFIX, to_prefix), (MIDDLE, to_middle), (SUFFIX, to_suffix)):
        for i in range(MARK):
            out[place[cut] - MARK + i] = mark[i]
    return out, out_ends


def gather(buf: np.ndarray, ends: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts back from the outputs and their forms."""
    row, at, kind = _marks(buf, ends)
    row, at, kind = (x[form[row] > 0] for x in (row, at, kind))
    place = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        mine = kind == mark[1]
        place[mark] = np.zeros(len(form), np.int64)
        place[mark][row[mine]] = at[mine]
        if not np.array_equal(row[mine], np.flatnonzero(form > 0)):
            raise ValueError("an output that is not plain has each sentinel once")
    lo, hi = ends[:-1], ends[1:]
    plain = form == 0
    p, s, m = (np.where(plain, lo, place[x] + MARK) for x in (PREFIX, SUFFIX, MIDDLE))
    prefix_end = np.choose(form, [hi, s - MARK, m - MARK])
    suffix_end = np.choose(form, [s, m - MARK, p - MARK])
    middle_end = np.where(plain, m, hi)
    text_ends = np.concatenate([[0], np.cumsum((prefix_end - p) + (middle_end - m) + (suffix_end - s))])
    base = text_ends[:-1]
    starts = np.stack([base, base + prefix_end - p, base + (prefix_end - p) + (middle_end - m)], 1)
    shift = np.stack([p, m, s], 1) - starts
    return buf[np.arange(text_ends[-1]) + _shifts(text_ends[-1], starts.ravel(), shift.ravel())], text_ends


def _points(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Code points between the places a and b."""
    seen = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return seen[b] - seen[a]


def _passes(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``PASS_BYTES`` bytes, or one row."""
    start, rows = 0, len(ends) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PASS_BYTES, side="right")) - 1)
        yield start, stop
        start = stop


def _one(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _rewrite(at: int, width: int, rate: int, spm: int, names: list[str]) -> Callable:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, borders = _bytes(batch.column(at))
            draw = np.stack([batch.column(width + i).to_numpy(zero_copy_only=False) for i in range(4)]).astype(np.int64)
            made: list[list[pa.Array]] = [[] for _ in kinds]
            for start, stop in _passes(borders):
                buf, ends = whole[borders[start] : borders[stop]], borders[start : stop + 1] - borders[start]
                c = _cut(buf, ends, draw[:, start:stop], rate, spm)
                plain = c["form"] == 0
                out = _strings(*scatter(buf, ends, c["form"], c["a"], c["b"]))
                sizes = (pa.array(_points(buf, x, y), mask=plain) for x, y in ((ends[:-1], c["a"]), (c["a"], c["b"])))
                for into, part in zip(made, (pa.array(c["n"]), pa.array(np.array(FORMS, object)[c["form"]], pa.string()), *sizes, out), strict=True):
                    into.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *map(_one, made, kinds)], names=names)

    return rewrite


def _rebuild(at: int, form_at: int, names: list[str]) -> Callable:
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, borders = _bytes(batch.column(at))
            form = np.array([FORMS.index(f) for f in batch.column(form_at).to_pylist()], np.int64)
            made = []
            for start, stop in _passes(borders):
                made.append(_strings(*gather(whole[borders[start] : borders[stop]], borders[start : stop + 1] - borders[start], form[start:stop])))
            yield pa.RecordBatch.from_arrays([*batch.columns, _one(made, pa.string())], names=names)

    return rebuild


def rewrite(docs: DataFrame, text: str = "text", key: str = "doc_id", rate: int = 100, spm: int = 50, seed: int = SEED) -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``docs`` and five more: lines, form, code points of prefix
    and middle (null if plain) and the output.  Their names, which give way to
    those that ``docs`` has, come as the second result.

    ``rate`` of 100 documents are rewritten, ``spm`` of 100 of those with the
    suffix first.  A null or empty text and one that holds a sentinel stay
    plain.  Draws hang on the key alone, so reruns agree and rows that repeat
    are rewritten alike; a null key draws as an empty one.  A text of any length
    is one row of one pass; nothing is shuffled.  An empty table gives an empty
    result.
    """
    names: dict[str, str] = {}
    fields = list(docs.schema.fields)
    for name, kind in (("lines", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())):
        names[name] = own_name(docs, f"fim_{name}")
        fields.append(T.StructField(names[name], kind))
    fed = docs.select("*", *(d.alias(own_name(docs, f"draw_{i}")) for i, d in enumerate(draws(key, seed))))
    task = _rewrite(docs.columns.index(text), len(docs.columns), rate, spm, [f.name for f in fields])
    return fed.mapInArrow(task, T.StructType(fields)), names


def restore(df: DataFrame, output: str, form: str) -> tuple[DataFrame, str]:
    """``df`` and the text rebuilt from output and form alone; the new column's
    name is the second result.  An output whose sentinels do not fit its form
    fails the job."""
    name = own_name(df, "fim_text")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])
    return df.mapInArrow(_rebuild(df.columns.index(output), df.columns.index(form), [f.name for f in schema.fields]), schema), name


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and
    restored_sha256 of every document."""
    made, names = rewrite(docs.select("doc_id", "text"))
    slim = made.select("doc_id", *(F.col(c).alias(k) for k, c in names.items()))
    back, text = restore(slim, "output", "form")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return back.select("doc_id", F.col("lines").alias("n"), "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha(text).alias("restored_sha256"))
