"""Fill-in-the-middle against a plain version, on edge rows and a small table."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.llm import fim

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, fim_form string, FIM_output int, draw_0 int, source string"
TEXTS = [
    (1, None), (2, ""), (3, "\n"), (4, "one line"), (5, "one line\n"), (6, "a\n\nb\n"), (7, "é\nü\U0001f600\n<P\n>"), (8, "holds <S> here"), (9, "<P>"), (10, "<\nP>\n<M"),
    (11, "x" * 30), (12, "long line\n" * 60_000), (13, "y" * 5_000_000), (None, "null\nid\n"), (15, "same\ntext\n"), (15, "same\ntext\n"), (16, "<<P\n<\n<S"), (17, "P>a\nS>b\nM>"), (18, "ends <"), (19, "<M"),
]


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(scope="module")
def edge(spark):
    more = [(i, f"line {i}\n" * (i % 9) + "<" * (i % 3)) for i in range(100, 400)]
    return spark.createDataFrame([(i, t, "f", 1, 2, None) for i, t in TEXTS + more], DOCS)


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 100), (0, 0)])
def test_rewrite_and_restore(spark, edge, rate, spm):
    for docs in (edge, spark.read.parquet(f"{SF}/documents.parquet")):
        made, names = fim.rewrite(docs, rate=rate, spm=spm)
        assert made.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in made.columns}) == len(made.columns)
        back, text = fim.restore(made, names["output"], names["form"])
        want = Counter((r.doc_id, r.text, *brute(r.doc_id, r.text, rate, spm), r.text or "") for r in docs.collect())
        assert Counter(map(tuple, back.select("doc_id", "text", *names.values(), text).collect())) == want


def test_many_passes(edge, monkeypatch):
    rows = [(r.doc_id, r.text) for r in edge.collect() if len(r.text or "") < 100_000]
    want = Counter((i, *brute(i, t)[:4], hashlib.sha256(brute(i, t)[4].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    small = edge.filter("text is null or length(text) < 100000")
    assert Counter(map(tuple, fim.digest(small).collect())) == want
    monkeypatch.setattr(fim, "PASS_BYTES", 16)  # a pass a few rows long
    import pyarrow as pa

    buf, ends = fim._bytes(pa.array([t for _, t in rows])[3:])
    assert sum(stop - start for start, stop in fim._passes(ends)) == len(rows) - 3 and bytes(buf[ends[1] : ends[2]]).decode() == rows[4][1]


def test_empty_table_and_broken_output(spark):
    docs = spark.createDataFrame([], DOCS)
    assert fim.digest(docs).count() == 0
    bad = spark.createDataFrame([("<P>a<S>b", "psm")], "o string, f string")
    with pytest.raises(Exception, match="each sentinel once"):
        fim.restore(bad, "o", "f")[0].collect()
    moved = spark.createDataFrame([("<P>a<S>b<M>c", "psm"), ("<S>b<P>a<M>c", "spm"), ("abc", "plain")], "o string, f string")
    back, text = fim.restore(moved, "o", "f")
    assert [r[0] for r in back.select(F.col(text)).collect()] == ["acb", "acb", "abc"]
