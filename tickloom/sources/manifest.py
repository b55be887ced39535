"""Inventories of raw files, and derived tables that are built once for each
state of their sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    """A Hadoop path with its file system's name, and that file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(where), fs


def raw_files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """dataset, path, bytes, modified of every file under ``root``, however
    deep: dataset is the first folder (or file) below the root, path goes on
    from the root.  Listed by the executors' file source; no content is read."""
    base = _path(spark, root)[0].toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.expr(f"substring(path, locate({base!r}, path) + {len(base)})")
    return files.select(F.substring_index(path, "/", 1).alias("dataset"), path.alias("path"), F.col("length").alias("bytes"), F.unix_micros("modificationTime").alias("modified"))


def _hash(version: str):
    """Files in any order: their number, the xor and the sum of a hash each."""
    one = F.xxhash64(F.lit(version), "path", "bytes", "modified")
    parts = (F.count(F.lit(1)), F.bit_xor(one), F.sum(one.cast("decimal(38,0)")))
    return F.sha2(F.concat_ws("|", F.lit(version), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def inventory(files: DataFrame, version: str = "1") -> DataFrame:
    """dataset, files, bytes and fingerprint: path, size and time of its files
    under a schema version."""
    return files.groupBy("dataset").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), _hash(version).alias("fingerprint"))


def derived_table(files: DataFrame, folder: str, build: Callable[[], DataFrame], version: str = "1") -> tuple[DataFrame, bool]:
    """The table that ``build`` gives, and whether it was there already.

    It lies under ``folder`` by the fingerprint of all its sources and the
    schema version.  A table counts as there once its write has ended, so a job
    that was cut off is done again, and one that repeats finds it.
    """
    spark = files.sparkSession
    path = f"{folder}/{files.agg(_hash(version).alias('h')).first()['h']}"
    mark, fs = _path(spark, f"{path}/_SUCCESS")
    found = fs.exists(mark)
    if not found:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), found
