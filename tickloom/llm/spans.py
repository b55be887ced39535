"""Positions of pattern matches as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:long,end:long,text:string>>"


#: matches a block; positions are running sums inside a block and over blocks,
#: so that a text with many matches copies no long array match by match
BLOCK = 128


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of the leftmost non-overlapping matches.

    ``split`` gives the stretches between the matches and
    ``regexp_extract_all`` the matches, so their lengths add up to positions
    (code points, end exclusive).  The pattern must not match an empty text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"))
    zero = F.lit(0).cast("long")
    none = F.struct(zero.alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("text"))).alias("spans"))

    def moved(acc: Column, block: Column) -> Column:
        own = F.transform(block["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["text"].alias("text")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.array_append(acc["blocks"], own).alias("blocks"))

    def in_blocks(p: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(p), F.lit(BLOCK))
        blocks = F.transform(starts, lambda k: F.aggregate(F.slice(p, k, F.lit(BLOCK)), none, step))
        start = F.struct(zero.alias("at"), F.array().cast(f"array<{SPAN}>").alias("blocks"))
        return F.flatten(F.aggregate(blocks, start, moved, lambda a: a["blocks"]))

    return F.when(text.rlike(pattern), in_blocks(parts)).otherwise(F.array().cast(SPAN))
