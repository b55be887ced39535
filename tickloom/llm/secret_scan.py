"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its content, and the ledger has one
row per scanned (blob, rule version).  A scan looks only at pairs that the
ledger does not have yet, once per blob however many paths hold it, and joins
the findings back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import text_or_empty

RULE_VERSION = "2"
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: runs of a class match whole, so a length of the match is a length of the run
_RULES = {
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    "private_key": re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    "web_token": re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    "forge_token": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
}
LEDGER = "blob binary, rule_version string, findings array<struct<kind:string,start:long,end:long>>"
_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, base kinds before others."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    for kind, rule in _RULES.items():
        out += [(kind, *m.span()) for m in rule.finditer(text)]
    order = [*KINDS, *_RULES]
    return sorted(out, key=lambda s: (s[1], order.index(s[0]), s[2]))


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """New ledger rows: one per blob of ``docs`` not yet scanned by ``version``."""
    text = text_or_empty(text_col)
    # copies combine before the shuffle, and the ledger is looked up in the
    # same partitioning by blob, so that a text is shuffled once at most
    blobs = docs.select(blob_id(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rule_version") == version).select("blob").hint("merge"), "blob", "left_anti")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * b.num_rows), pa.array(found, _FINDINGS)], names=["blob", "rule_version", "findings"])

    return blobs.mapInArrow(look, LEDGER)


def update_ledger(docs: DataFrame, folder: str, version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """Bring the ledger in ``folder`` up to date with one more version of the
    table, and return it.

    Only pairs of a blob and this rule version that it lacks are scanned and
    appended; what was scanned before, by whichever version of the table or of
    the rules, stays.  A task that runs again leaves one set of rows, as the
    write commits whole.
    """
    spark = docs.sparkSession
    known = read_ledger(spark, folder)
    scan(docs, known, version, text_col).write.mode("append").parquet(folder)
    return read_ledger(spark, folder)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger in ``folder``; without rows where none was written yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    exists = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(LEDGER).parquet(folder) if exists else spark.createDataFrame([], LEDGER)


def findings_by_path(docs: DataFrame, ledger: DataFrame, version: str = RULE_VERSION, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every path with the findings of its blob: path, blob, findings.

    Null texts count as empty, rows that repeat are paths of their own, texts
    of any length are scanned whole, further columns are ignored, and an empty
    table has no paths.
    """
    hits = ledger.filter((F.col("rule_version") == version) & (F.size("findings") > 0)).select("blob", "findings")
    paths = docs.select(F.col(path_col), blob_id(text_or_empty(text_col)).alias("blob"))
    none = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    return paths.join(hits, "blob", "left").select(path_col, "blob", F.coalesce("findings", none).alias("findings"))


def digest(found: DataFrame) -> DataFrame:
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("findings", lambda s: s["kind"].isin(*KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))
