"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 segments of two
bits.  Changing one bit changes one count by one, so the Manhattan distance of
two embeddings is a lower bound of the Hamming distance.  The range join under
that bound runs on the integer grid of embeddings: every fingerprint is placed
in its own cell and the cells one step away, and two embeddings at distance
two or less always share a cell.  The fingerprints that meet in a cell are the
candidates, and each candidate pair is verified on its bits.  Cells of up to
``CELL`` fingerprints compare theirs directly; those of fuller cells are dealt
out again by the words within one bit, of which two fingerprints share one if
and only if they differ in two bits or fewer, so that no group is compared
with the square of its size.

``near_components`` is the operator for whole similarity classes: links of
fingerprints of five-word shingles and buckets of MinHash values propose pairs,
every pair is checked on the whole shingle sets, and a prefix join compares what
is still in different classes, so that no link between two classes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import minhash
from tickloom.llm.common import drop, materialise, new_folder, own_name, small_batches, written
from tickloom.llm.components import components

SEED = 42
SHINGLE = 3
#: the grid's step and the words within one bit are made for this radius
MAX_DISTANCE = 2
CELL = 64
#: near_components: documents whose shingles are counted to order all shingles, and shingles that get a place of their own
COUNTED, COMMON = 65_536, 200_000
BATCH_ROWS = 250
_EVEN = 0x5555555555555555


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64, count=max(1, len(words) - n + 1))
    ones = np.zeros(64, np.int64)
    for part in np.array_split(h, len(h) // 65536 + 1):
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _embedding(fp: Column) -> Column:
    """The bit counts of the 32 segments, two bits a segment."""
    even = F.lit(_EVEN).cast("long")
    a, b = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))


#: the cell of an embedding v and those one step away; a step up or down in a
#: segment changes its two bits, 00, 01 or 10, by xor with 01 or 11
_CELLS = """concat(array(v), flatten(transform(sequence(0, 62, 2), i ->
    CASE shiftrightunsigned(v, i) & 3 WHEN 0 THEN array(v ^ shiftleft(1L, i)) WHEN 2 THEN array(v ^ shiftleft(3L, i))
    ELSE array(v ^ shiftleft(1L, i), v ^ shiftleft(3L, i)) END)))"""
_WORDS = "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))"


def _linked_in(fps: Column, radius: int) -> Column:
    """(a, b) of the members of one cell that differ in ``radius`` bits or fewer."""
    def with_earlier(x: Column, i: Column) -> Column:
        close = F.filter(F.slice(fps, F.lit(1), i), lambda y: F.bit_count(x.bitwiseXOR(y)) <= radius)
        return F.transform(close, lambda y: F.struct(x.alias("a"), y.alias("b")))

    return F.flatten(F.transform(fps, with_earlier))


def link_edges(fps: DataFrame) -> DataFrame:
    """Distinct ``fp`` → edges (a, b), all of them true links, that join
    exactly the fingerprints reachable by links of two bits or fewer."""
    spark = fps.sparkSession
    fps = fps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but each row makes many
    placed = fps.select("fp", _embedding(F.col("fp")).alias("v")).select("fp", F.explode(F.expr(_CELLS)).alias("cell"))
    shared = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a fingerprint makes 33 to 65 rows that Spark's estimate does not count, so none of this is broadcast
    met = materialise(placed.join(shared.hint("merge"), "cell").select("cell", "n", "fp"))
    few = met.filter(F.col("n") <= CELL).groupBy("cell").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    direct = few.select(F.explode(_linked_in(F.col("fps"), MAX_DISTANCE)).alias("e")).select("e.a", "e.b")
    # at most 65 different fingerprints lie within one bit of a word
    words = met.filter(F.col("n") > CELL).select("fp").distinct().select("fp", F.explode(F.expr(_WORDS)).alias("word"))
    full = words.groupBy("word").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    star = full.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)
    return direct.union(star).filter("a != b").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id.

    A null text counts as empty (fingerprint zero, linked like any other); a
    component of only null ids has a null component_id; rows that repeat are
    returned as often as they come; texts of any length are read whole;
    further columns are ignored; an empty table gives an empty result.
    """
    rows = materialise(fingerprints(docs, id_col, text_col))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    member = components(link_edges(nodes.select("fp")))
    # what is joined grows with the rows, so it is never broadcast
    labelled = nodes.join(member.hint("merge"), nodes.fp == member.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = labelled.join(least.hint("merge"), "component").select("fp", "component_id")
    return rows.join(by_fp.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_components(docs: DataFrame, shingle: int = minhash.SHINGLE, similarity: float = minhash.SIMILARITY) -> DataFrame:
    """One row per document: doc_id, component_id, the smallest doc_id that
    links of ``similarity`` or more between sets of ``shingle``-word shingles
    reach.

    Nodes are the different sets.  Fingerprints that differ in two bits or fewer
    propose pairs, and so do buckets, in which every set is compared with the
    hub, the one whose buckets are fullest.  That joins most near copies to
    classes, which are written once.  Every link between two classes is then found by a prefix join
    (``minhash.prefixes``) of the sets that are not of the same class.  Its order
    of the shingles has those last that are common in ``COUNTED`` documents;
    any order gives the same result, this one small groups.  A group's largest
    class is not compared with itself; sizes, places, 1,024 bits of parity and the
    number of shared places drop pairs that cannot reach the similarity; the
    whole sets decide.

    Null texts count as empty, a component of only null ids has a null
    component_id, rows that repeat are returned as often as they come, texts of
    any length are read whole, further columns are ignored, and an empty table
    gives an empty result.
    """
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "near")
    own = small_batches(spark, BATCH_ROWS)  # sets of long texts are large
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = ", ".join(f"{b} long" for b in minhash.SKETCH)
    kept = {"rows": minhash.SIGNED, "nodes": f"node long, first_id long, fp long, size int, {sketch}", "met": "node long, bucket long, n long", "hubs": "bucket long, hub long", "classes": "node long, component long", "shared": minhash.PREFIX, "live": f"{minhash.PREFIX}, c long, main long, {sketch}"}

    def read(name: str, kind: str | None = None, session=spark) -> DataFrame:
        return session.read.schema(kind or kept[name]).parquet(f"{folder}/{name}")

    written(texts.mapInArrow(minhash.sign(shingle), minhash.SIGNED), folder, "rows")
    written(read("rows").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("size", *minhash.SKETCH))), folder, "nodes")
    placed = read("rows").select("node", F.explode("buckets").alias("bucket")).distinct()
    counted = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    written(placed.join(counted.hint("merge"), "bucket").select("node", "bucket", "n"), folder, "met")
    met = read("met")
    weight = met.groupBy("node").agg(F.sum("n").alias("w"))
    heaviest = met.join(weight.hint("merge"), "node").groupBy("bucket").agg(F.max(F.struct("w", "node")).alias("m"))
    written(heaviest.select("bucket", F.col("m.node").alias("hub")), folder, "hubs")
    of_fp = read("nodes").groupBy("fp").agg(F.min("node").alias("rep"))
    fp_pairs = link_edges(of_fp.select("fp")).join(of_fp.select(F.col("fp").alias("a"), F.col("rep").alias("x")).hint("merge"), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("rep").alias("y")).hint("merge"), "b").select("x", "y")
    pairs = met.join(read("hubs").hint("merge"), "bucket").select(F.col("node").alias("x"), F.col("hub").alias("y"))
    pairs = pairs.union(fp_pairs).union(read("nodes").join(of_fp.hint("merge"), "fp").select(F.col("node").alias("x"), F.col("rep").alias("y")))
    edge = "a long, b long"

    def possible() -> Column:
        """The sketches of sets x and y differ in no more bits than the sets may in shingles."""
        differing = sum(F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in minhash.SKETCH)
        return differing * (1 + similarity) <= (F.col("x.size") + F.col("y.size")) * (1 - similarity) + 1e-6

    def checked(name: str) -> DataFrame:
        """The pairs of table ``name`` whose whole sets are similar."""
        asked = read(name, edge).select(F.explode(F.array("a", "b")).alias("node")).distinct()
        one = read("rows").join(asked.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
        written(one, folder, f"{name}-sets")
        sets = read(f"{name}-sets", "node long, shingles binary", own)
        whole = read(name, edge, own).join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
        written(whole.select("a", "b", "x", "y").mapInArrow(minhash.similar(similarity), edge), folder, f"{name}-links")
        drop(spark, f"{folder}/{name}-sets")
        return read(f"{name}-links", edge)

    nodes = read("nodes").drop("first_id", "fp")
    pairs = pairs.filter("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    pairs = pairs.join(nodes.alias("x").hint("merge"), F.col("a") == F.col("x.node")).join(nodes.alias("y").hint("merge"), F.col("b") == F.col("y.node"))
    written(pairs.filter(possible()).select("a", "b"), folder, "pairs")
    written(components(checked("pairs")), folder, "classes")
    member = read("classes")

    share = COUNTED / max(read("rows").count(), COUNTED)
    some = read("rows", session=own).filter(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < share * (1 << 20)).select("shingles")
    often = some.mapInArrow(minhash.tokens, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    written(often.orderBy(F.desc("n"), "token").limit(COMMON), folder, "often")
    often = read("often", "token long, n long").toArrow().sort_by([("n", "descending"), ("token", "ascending")])
    often = often.column("token").to_numpy().view(np.uint64)
    by_token = np.argsort(often)
    common = spark.sparkContext.broadcast((often[by_token], len(often) - by_token))
    firsts = read("rows", session=own).select("node", "shingles").mapInArrow(minhash.prefixes(similarity, common), minhash.PREFIX)
    together = Window.partitionBy("token")
    firsts = firsts.select("*", F.min("node").over(together).alias("lo"), F.max("node").over(together).alias("hi"))
    written(firsts.filter("lo != hi").drop("lo", "hi").distinct(), folder, "shared")
    named = read("shared").join(member.hint("merge"), "node", "left").select(*read("shared").columns, F.coalesce("component", "node").alias("c"))
    main = named.groupBy("token", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max(F.struct("n", "c")).alias("m"), F.count(F.lit(1)).alias("k"))
    live = named.join(main.filter("k > 1").select("token", F.col("m.c").alias("main")).hint("merge"), "token").join(nodes.drop("size").hint("merge"), "node")
    written(live.select(*(c.split()[0] for c in kept["live"].split(", "))), folder, "live")
    x, y = read("live").filter("c != main").alias("x"), read("live").alias("y")
    larger = F.expr("x.size > y.size or x.size = y.size and x.node > y.node")
    reach = (F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * similarity - 1e-6) & ((F.least("x.left", "y.left") + minhash.MEET - 1) * (1 + similarity) >= (F.col("x.size") + F.col("y.size")) * similarity - 1e-6)
    once = F.expr("y.c = y.main or x.node > y.node")
    overlap = F.ceil((F.col("x.size") + F.col("y.size")) * (similarity / (1 + similarity)) - 1e-6)
    more = x.join(y.hint("merge"), (F.col("x.token") == F.col("y.token")) & (F.col("x.c") != F.col("y.c")) & once & F.when(larger, F.col("y.indexed")).otherwise(F.col("x.indexed")) & reach & possible())
    more = more.groupBy(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"), F.least(F.lit(minhash.MEET), overlap).alias("least"))
    written(more.agg(F.count(F.lit(1)).alias("n")).filter("n >= least").select("a", "b"), folder, "more")
    # a link joins the classes of its ends, each known by its smallest node, so the rounds see nothing of what lies inside a class
    ends = checked("more").join(member.toDF("a", "p").hint("merge"), "a", "left").join(member.toDF("b", "q").hint("merge"), "b", "left")
    joined = components(ends.select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b"))).toDF("c", "whole")
    common.destroy()
    labelled = read("nodes").join(member.hint("merge"), "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("c"))
    labelled = labelled.join(joined.hint("merge"), "c", "left").select("node", "first_id", F.coalesce("whole", "c").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labelled = labelled.join(least.hint("merge"), "component").select("node", "component_id")
    out = materialise(read("rows").select("doc_id", "node").join(labelled.hint("merge"), "node").select("doc_id", "component_id"))
    drop(spark, folder)
    return out


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """The document with the smallest id of each component, with its columns;
    rows that repeat that id stay with it."""
    key = own_name(docs, "near_id")
    stay = near_components(docs, **kw).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(stay.hint("merge"), docs["doc_id"].eqNullSafe(stay[key]), "left_semi")
