"""Exact deduplication by 128-bit content hash with a comparison of bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import lower_ascii, own_name, text_or_empty


def content_hash(c: Column) -> Column:
    """128 bits of the normalised text, as binary."""
    return F.unhex(F.md5(c))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Callable[[Column | str], Column] = F.max,
    hash_fn: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows fall into groups by ``hash_fn`` of the normalised text, and inside
    those by the bytes themselves, so a collision of the hash cannot merge two
    texts: the aggregate carries (hash, text) as its key and combines copies
    before the shuffle, however many a group has.  Rows then look up their
    class by (hash, SHA-256); should two different texts ever share both, the
    job fails instead of merging them.

    ``keep`` is F.max or F.min of the id.  A null text counts as empty, a null
    id never wins against another one, rows that repeat id and text of the
    row that stays are the same document and are all ``kept`` (``keep_one``
    returns one of them), and an empty table gives an empty result.  Texts of
    any length are compared whole.  Further columns are ignored, whatever
    their names.
    """
    norm = lower_ascii(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    classes = (
        rows.select("id", "norm", hash_fn(F.col("norm")).alias("h"))
        .groupBy("h", "norm")
        .agg(keep("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep_id", "group_size")
        .groupBy("h", "sha")
        .agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share both hashes")).cast("long")))
    )
    keyed = rows.select("id", hash_fn(F.col("norm")).alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    return keyed.join(classes, ["h", "sha"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; one row each.

    A row is looked up by its text's SHA-256 and its id in one string key, so
    the join and the choice among repeated rows share one exchange.
    """
    id_col, key = kw.get("id_col", "doc_id"), own_name(docs, "row_key")
    sha = F.sha2(lower_ascii(text_or_empty(kw.get("text_col", "text"))).cast("binary"), 256)
    named = lambda sha: F.concat_ws(":", sha, F.col(id_col).cast("string"))
    stay = exact_dedup(docs, **kw).filter("kept").select(named(F.col("text_sha256")).alias(key))
    return docs.withColumn(key, named(sha)).join(stay, key, "left_semi").dropDuplicates([key]).select(*(docs[c] for c in docs.columns))
