"""Mixing sources to target weights with Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import own_name

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2
#: slices of the key range between two powers of two
SLICES = 1024


def n_words(c: Column) -> Column:
    """Runs of anything but the six ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) → + target.

    A target is its weight times a common level, but at most ``max_epochs``
    times the source.  Sources that stop at that bound are those with the
    smallest ratio of bound to weight, so the level after all resharing comes
    from sums over the sources in order of that ratio.  The windows here run
    over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    base = sizes.withColumn("w", w).withColumn("bound", F.col("source_size") * float(max_epochs))
    base = base.withColumn("ratio", F.col("bound") / F.col("w"))
    total = F.sum("source_size").over(every) * float(share)
    level = (total - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    base = base.withColumn("level", level)
    free = F.when(F.col("ratio") >= F.col("level"), F.col("level"))
    # the first source, in order, that its bound does not stop sets the level
    base = base.withColumn("level", F.first(free, ignorenulls=True).over(every))
    return base.select("source", "source_size", F.coalesce(F.least("bound", F.col("w") * F.col("level")), F.col("bound")).alias("target"))


def es_key(id_col: Column, weight: Column, seed: int) -> Column:
    """Exponential key -ln(u)/weight with u in (0, 1) from a hash of the id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11)
    u = (bits.cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def _slice(key: Column, slices: int) -> Column:
    """Ascending with the key, and fine at every scale of it, so that documents
    of any weight are spread over many slices."""
    k = F.greatest(key, F.lit(1e-18))
    power = F.floor(F.log2(k))
    part = F.floor((k / F.pow(F.lit(2.0), power) - 1) * slices)
    return (power * slices + F.greatest(F.lit(0), F.least(part, F.lit(slices - 1)))).cast("int")


def mix_sources(
    docs: DataFrame,
    weight_by: DataFrame | None = None,
    size: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
    slices: int = SLICES,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, epochs.

    Every document is taken in all complete epochs of its source's target.
    The rest of the target goes to the documents with the smallest
    exponential keys, whole documents each, so that the words taken end
    within half of the last document's size of the target.  Positions in key
    order come from slices of the key range: sums per slice, and inside each
    slice a running sum, so that no source is sorted in one task.

    ``weight_by`` has the quality weight of a doc_id, one row each (positive;
    1 where none is given); those weights, small rows, join the sizes.  A null
    text has size 0 and is never taken; a null source is a source of its own,
    the last one; ties in the key go to the smaller doc_id, then size; rows
    that repeat are documents each; texts of any length are counted whole;
    further columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "source", (size if size is not None else n_words(F.col("text"))).cast("long").alias("size"))
    if weight_by is None:
        rows = rows.withColumn("wt", F.lit(1.0))
    else:
        weight_of = weight_by.select(F.col("doc_id").alias("wid"), F.greatest(F.col("weight").cast("double"), F.lit(1e-6)).alias("wt"))
        rows = rows.join(weight_of, rows["doc_id"] == weight_of["wid"], "left").drop("wid").withColumn("wt", F.coalesce("wt", F.lit(1.0)))
    rows = rows.withColumn("key", es_key(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("wt"), seed))
    rows = rows.withColumn("slice", _slice(F.col("key"), slices)).drop("wt")
    # a hash of the source keeps null sources joinable
    rows = rows.withColumn("sid", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    per_slice = rows.groupBy("sid", "source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("sid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slice_start = per_slice.select("sid", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("slice_start"))
    per_source = per_slice.groupBy("sid", "source").agg(F.sum("slice_size").alias("source_size"))
    goal = targets(per_source.select("source", "source_size"), weights, share, max_epochs)
    goal = goal.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("sid"), "source_size", "target")
    plan = slice_start.join(goal, "sid")
    inside = Window.partitionBy("sid", "slice").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(plan, ["sid", "slice"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("epochs", epochs).withColumn("start", F.col("start") + F.col("slice_start"))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    partial = (F.col("start") + F.col("size") / 2 <= rest) & (F.col("size") > 0)
    return placed.select(
        "doc_id",
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        (F.col("size") * (F.col("epochs") + partial.cast("long"))).alias("taken"),
        "epochs",
    )


def repeated(docs: DataFrame, weight_by: DataFrame | None = None, **kw) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own
    columns.  Rows that repeat an id are all taken as often as the id's most
    taken row."""
    key, times, copy = (own_name(docs, n) for n in ("mix_id", "mix_times", "mix_copy"))
    mixed = mix_sources(docs, weight_by, **kw).filter("taken > 0")
    each = mixed.groupBy(F.col("doc_id").alias(key)).agg(F.max(F.expr("cast(taken div size as int)")).alias(times))
    once = docs.join(each, docs["doc_id"].eqNullSafe(F.col(key)))
    return once.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(docs[c] for c in docs.columns))
