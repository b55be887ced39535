"""WARC archives as a Spark data source written in Python.

Reading plans one partition per archive file (``.warc``, or ``.warc.gz`` with a
gzip member a record), takes record-type and header predicates from the query,
parses each record's headers first, and skips the block of a record that no row
needs without decoding it.  Records of any type and of other writers are rows
too; what a header does not say is null.  Writing keeps one response per payload
and revisit records for its copies.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import operator
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from tickloom.llm.common import shared_dir

ROLL_BYTES = 64 << 20
SCHEMA = "record_id string, record_type string, page_id long, target_uri string, refers_to_id string, refers_to long, content_type string, payload_bytes long, payload_digest string, payload string"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-page:"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The id of the response record of a page and payload, so that a revisit
    can name it without a look at the archives."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{_URN}{page_id}:{digest}')}>"


def encode_record(record_type: str, page_id: int | None, uri: str | None, refers_to: int | None, payload: str | None, digest: str, size: int) -> bytes:
    """One record; the payload has gzip content encoding."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if record_type == "response":
        body = gzip.compress((payload or "").encode("utf-8", "surrogatepass"), 6, mtime=0)
        block = http + b"Content-Encoding: gzip\r\n\r\n" + body
    else:
        block = http + b"\r\n"
    head = {
        "WARC-Type": record_type,
        "WARC-Record-ID": record_id(page_id, digest) if record_type == "response" and page_id is not None else f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join(uri.split()) if uri else None,
        "WARC-Page-ID": None if page_id is None else f"<{_URN}{page_id}>",
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to, digest),
        "WARC-Refers-To-Page-ID": None if refers_to is None else f"<{_URN}{refers_to}>",
        "WARC-Profile": _PROFILE if record_type == "revisit" else None,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": size,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _page(value: str | None) -> int | None:
    text = (value or "").strip("<>").removeprefix(_URN)
    return int(text) if re.fullmatch("-?[0-9]+", text) else None


def _header_text(line: bytes) -> str:
    """A header line in UTF-8 or, as some writers send it, Latin-1."""
    try:
        return line.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return line.decode("latin-1")


#: predicates on headers that the reader checks itself; a null passes none but IsNull
_TESTS: dict[type, Callable[[object, object], bool]] = {
    EqualTo: operator.eq,
    GreaterThan: operator.gt,
    GreaterThanOrEqual: operator.ge,
    LessThan: operator.lt,
    LessThanOrEqual: operator.le,
    StringStartsWith: lambda x, v: x.startswith(v),
    In: lambda x, v: x in v,
    IsNotNull: lambda x, v: True,
}


@dataclass
class ArchiveFile(InputPartition):
    path: str | None


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payload: bool):
        self.folder, self.payload, self.wanted = folder, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a header column with values are checked on the headers."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            # a payload's size is known for certain only once it is decoded
            if column in (None, "payload", "payload_bytes", "payload_digest") or type(f) not in (*_TESTS, IsNull):
                yield f
            else:
                self.wanted.append((column, type(f), getattr(f, "value", None)))

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, path = filesystem(self.folder)
        files = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [ArchiveFile(f.path) for f in files if f.is_file and f.path.endswith((".warc", ".warc.gz"))] or [ArchiveFile(None)]

    def _fits(self, row: dict) -> bool:
        return all(row[c] is None if kind is IsNull else row[c] is not None and _TESTS[kind](row[c], value) for c, kind, value in self.wanted)

    def read(self, partition: ArchiveFile) -> Iterator[tuple]:
        if partition.path is None:
            return
        store, _ = filesystem(self.folder)
        with store.open_input_file(partition.path) as raw:
            packed = partition.path.endswith(".gz")
            yield from self.records(gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 16), partition.path)

    def records(self, f, path: str) -> Iterator[tuple]:
        while line := f.readline():
            if not line.strip():
                continue  # the blank lines after a record
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record where one should begin")
            head, k = {}, None
            while line := f.readline().rstrip(b"\r\n"):
                text = _header_text(line)
                if k is not None and text[0] in " \t":
                    head[k] = f"{head[k]} {text.strip()}".strip()  # a folded value goes on
                else:
                    k, _, v = text.partition(":")
                    k = k.strip().lower()
                    head[k] = v.strip()
            if not re.fullmatch("[0-9]+", head.get("content-length", "")):
                raise ValueError(f"{path}: record {head.get('warc-record-id')} does not tell its length")
            length = int(head["content-length"])
            algorithm, _, digest = head.get("warc-payload-digest", "").partition(":")
            told = head.get("warc-payload-length")
            row = {
                "record_id": head.get("warc-record-id"),
                "record_type": head.get("warc-type"),
                "page_id": _page(head.get("warc-page-id")),
                "target_uri": head.get("warc-target-uri"),
                "refers_to_id": head.get("warc-refers-to"),
                "refers_to": _page(head.get("warc-refers-to-page-id")),
                "content_type": head.get("content-type"),
                "payload_bytes": int(told) if told and re.fullmatch("[0-9]+", told) else None,
                "payload_digest": digest or None,
                "payload": None,
            }
            fits = self._fits(row)
            if not fits or not self.payload or row["record_type"] not in ("response", "resource"):
                f.seek(length, 1)
            else:
                block = f.read(length)
                http, _, body = block.partition(b"\r\n\r\n") if row["content_type"] and row["content_type"].startswith("application/http") else (b"", b"", block)
                coded = re.search(rb"(?im)^content-encoding:[ \t]*(x-)?gzip", http)
                data = gzip.decompress(body) if coded else body
                row |= {"payload_bytes": len(data), "payload": data.decode("utf-8", "replace" if told is None else "surrogatepass")}
                # of other writers, some digest what was sent and some what it stood for
                if algorithm == "sha1" and not {sha1_base32(data), sha1_base32(body)} & {digest.upper()}:
                    raise ValueError(f"{path}: payload of record {row['record_id']} is damaged")
            if fits:
                yield tuple(row.values())


class WarcWriter(DataSourceWriter):
    """Each task writes archives of its own under _tmp; the commit moves them,
    so that a task run twice leaves one set."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> Written:
        store, path = filesystem(self.folder)
        store.create_dir(f"{path}/_tmp", recursive=True)
        paths, out, size = [], None, 0
        for r in iterator:
            if out is None or size > ROLL_BYTES:
                if out is not None:
                    out.close()
                paths.append(f"{path}/_tmp/{uuid.uuid4().hex}.warc")
                out, size = store.open_output_stream(paths[-1]), 0
            record = encode_record(r.record_type, r.page_id, r.target_uri, r.refers_to, r.payload, r.payload_digest, r.payload_bytes)
            out.write(record)
            size += len(record)
        if out is not None:
            out.close()
        return Written(paths)

    def commit(self, messages: list) -> None:
        store, _ = filesystem(self.folder)
        for m in messages:
            for p in m.paths if m else []:
                store.move(p, p.replace("/_tmp/", "/"))

    def abort(self, messages: list) -> None:
        store, _ = filesystem(self.folder)
        for m in messages:
            for p in m.paths if m else []:
                store.delete_file(p)


class WarcDataSource(DataSource):
    """Options: path; payload=false reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows for the writer.  Of equal payloads of at least ``min_bytes`` the
    smallest page_id is the response and the others revisit it.  A null html
    is an empty payload; a null page_id never stands for others; rows that
    repeat the response's id are responses too; payloads of any length are
    written whole; further columns are ignored; an empty table gives none."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("key", F.unhex(F.sha2(F.col("payload").cast("binary"), 256))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # who stands for a payload is settled on ids and hashes; the payloads meet
    # that by id, so a page copied very often does not go to one task
    light = p.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "key").distinct()
    first = light.groupBy("key").agg(F.min("page_id").alias("first_id"))
    first = light.join(first, "key").select(F.col("page_id").alias("of_id"), F.col("key").alias("of_key"), "first_id")
    j = p.join(first, F.col("page_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    digest = F.sha1(F.col("payload").cast("binary"))
    return j.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "page_id",
        "target_uri",
        F.when(again, F.col("first_id")).alias("refers_to"),
        "payload_bytes",
        _base32(digest).alias("payload_digest"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def _base32(hex_digest):
    """Hex of whole five-byte groups of a SHA-1 → base32, 40 bits at a time;
    ``conv`` counts in other digits than the archive format."""
    own, alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = (F.lpad(F.conv(F.substring(hex_digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31))
    return F.translate(F.concat(*groups), own, alphabet)


def write_pages(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    register(pages.sparkSession)
    records(pages, min_bytes).write.format("warc").mode("append").save(folder)


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def page_report(spark: SparkSession, folder: str) -> DataFrame:
    """What the archives say of each page: payloads of responses are decoded
    and verified; revisits come from headers alone, the predicate on the record
    type skipping every block."""
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    held = read(spark, folder).filter("record_type = 'response'").select(*columns)
    again = read(spark, folder, payload=False).filter("record_type = 'revisit'").select(*columns)
    return held.union(again)
