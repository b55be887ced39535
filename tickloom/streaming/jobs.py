"""Structured Streaming jobs: run what has arrived, then stop.

Every job reads files as a stream, keeps its offsets and state under a
checkpoint in the shared folder, and appends to a table there; started again
with the same folder it goes on where it ended.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_folder(spark: SparkSession, kind: str = "stream") -> str:
    """A new folder where the cluster says that all can read and write; only a
    local master may do without such a setting."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or tempfile.mkdtemp(prefix='spark-shared-')}/{kind}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The files at ``path``, a folder or a single file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # only a pattern may name a file


def append(stream: DataFrame, folder: str) -> DataFrame:
    """Run what is there in append mode; the table so far."""
    spark = stream.sparkSession
    job = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check")
    job.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def upsert(stream: DataFrame, keys: Sequence[str], folder: str) -> DataFrame:
    """Run in update mode; of each key the version of the last batch.

    A batch that is written again after a failure replaces its own part.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    job = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/check")
    job.outputMode("update").trigger(availableNow=True).start().awaitTermination()
    versions = spark.read.parquet(f"{folder}/out")
    last = F.max_by(F.struct(*stream.columns), "batch")
    return versions.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(last.alias("__r")).select("__r.*")


def run_record(stream: DataFrame, at: str, folder: str) -> DataFrame:
    """One row per batch that had rows: rows and the range of ``at``."""

    def write(batch: DataFrame, number: int) -> None:
        seen = batch.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
        seen.filter("n > 0").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    job = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/check")
    job.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")


def keyed_scan(stream: DataFrame, by: str, order: Sequence[str], x: str, name: str, step: Callable[[float, float | None], float], start: float = 0.0) -> DataFrame:
    """(by, order, name) where name = step(name before, x), row after row.

    The value carried lives in the state of its key; within a batch the rows
    of a key come in ``order``, across batches in arrival.
    """
    columns = [by, *order]
    schema = stream.select(*columns).schema.add(name, "double")

    def scan(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf, y, out = pd.concat(list(parts)).sort_values(list(order), kind="stable"), state.get[0] if state.exists else start, []
        for v in pdf[x].to_numpy():
            y = float(step(y, None if v is None or v != v else float(v)))
            out.append(y)
        state.update((y,))
        yield pdf[columns].assign(**{name: out})

    return stream.select(*columns, x).groupBy(by).applyInPandasWithState(scan, schema, "y double", "append", GroupStateTimeout.NoTimeout)
