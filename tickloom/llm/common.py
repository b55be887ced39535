"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's
    ``spark.checkpoint.dir``.  Where it is unset, a local master gets a
    temporary folder; on a cluster that is an error, as no other machine would
    see such a folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-shared-"))
    return folder or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` is cheaper than ``translate`` and does the same where a text has
    no other characters than ASCII.
    """
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def own_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def materialise(df: DataFrame) -> DataFrame:
    """Compute once into Parquet in the shared folder and read it from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, folder: str, name: str) -> str:
    """Write ``df`` as Parquet under ``folder``; its path."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int) -> SparkSession:
    """A session of its own on the same cluster that hands Python ``rows`` rows
    at a time, so that no other query of the caller's session sees the setting."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.ansi.enabled", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return own
