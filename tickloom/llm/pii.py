"""Personal data: candidate spans, boosted trees, calibrated redaction.

High-recall generators propose spans of several kinds, which may overlap.  The
four base kinds are settled by their formats alone.  Every other proposal is
scored by gradient-boosted trees over format and context features, and is
redacted where the score reaches a threshold calibrated for precision on held
out candidates.

The trees learn from spans whose nature is known without those generators: a
validated address or number of the corpus, rewritten in its place in another
form (an address spelled out, a number without its plus sign), is personal data
that no base pattern matches; a date, version, range or sum put in its place,
and what the generators propose elsewhere, is not.  The trees are CASE
expressions, so all of the main path is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialise
from tickloom.llm.spans import matches

_LOCAL = "A-Za-z0-9._%+-"
#: Java forms of the base patterns.  Possessive loops and the look-behind keep
#: the same matches without recursion or a second scan of a long run.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: generators of further candidates
EXTRA = {
    "email_like": r"\b[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "number_like": r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?(?:[\x20./-]\(?[0-9]{2,7}\)?){1,5}(?![0-9A-Za-z])",
    "iban_like": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
}
KINDS = tuple(BASE)
#: bounds of the sample that the trees are fitted on
SAMPLE_DOCS, SAMPLE_CANDIDATES = 8000, 20000
CONTEXT = 24


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), _small)
    if kind == "card":
        d = _digits(text)
        n = F.char_length(d)
        return F.when(n.between(13, 19), F.call_function("luhn_check", d)).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(text)).between(9, 15)
    return F.lit(True)


def _small(part: Column) -> Column:
    """A run of digits of at most 255, whatever its leading zeros."""
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.char_length(short) <= 3, short.cast("int") <= 255).otherwise(False)


def base_spans(text: Column) -> dict[str, Column]:
    def settled(kind: str, pattern: str) -> Column:
        return F.filter(matches(text, pattern), lambda s: _valid(kind, s["text"]))

    return {k: settled(k, p) for k, p in BASE.items()}


def _tagged(kind: str, spans: Column, base: bool) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base")))


@dataclass
class Node:
    feature: int = 0
    cut: float = 0.0
    value: float = 0.0
    low: Node | None = None
    high: Node | None = None


@dataclass
class Boosted:
    base: float
    trees: list[Node] = field(default_factory=list)
    threshold: float = 2.0

    def column(self, x: Sequence[Column]) -> Column:
        def case(n: Node) -> Column:
            return F.lit(n.value) if n.low is None else F.when(x[n.feature] <= n.cut, case(n.low)).otherwise(case(n.high))

        score = sum((case(t) for t in self.trees), F.lit(self.base))
        return 1 / (1 + F.exp(-score))

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(n: Node, rows: np.ndarray, out: np.ndarray) -> None:
            if n.low is None:
                out[rows] += n.value
            else:
                left = x[rows, n.feature] <= n.cut
                walk(n.low, rows[left], out), walk(n.high, rows[~left], out)

        s = np.full(len(x), self.base)
        for t in self.trees:
            walk(t, np.arange(len(x)), s)
        return 1 / (1 + np.exp(-s))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float) -> Node:
    total = lambda r: (g[r].sum(), h[r].sum() + 1.0)
    gs, hs = total(rows)
    leaf, best = Node(value=rate * gs / hs), (1e-6, None)
    if depth:
        for f in range(x.shape[1]):
            for c in np.unique(np.quantile(x[rows, f], np.linspace(0.05, 0.95, 10)))[:12]:
                left = x[rows, f] <= c
                if 0 < left.sum() < len(rows):
                    (ga, ha), (gb, hb) = total(rows[left]), total(rows[~left])
                    gain = ga * ga / ha + gb * gb / hb - gs * gs / hs
                    if gain > best[0]:
                        best = (gain, (f, float(c), left))
    if best[1] is None:
        return leaf
    f, c, left = best[1]
    return Node(f, c, 0.0, _grow(x, g, h, rows[left], depth - 1, rate), _grow(x, g, h, rows[~left], depth - 1, rate))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 16, depth: int = 2, rate: float = 0.4, precision: float = 0.98) -> Boosted:
    """Fit on three quarters of the rows; the threshold is the smallest score
    from which on the precision on the last quarter is at least that given."""
    held = np.arange(len(y)) % 4 == 3
    if not y[~held].any() or y[~held].all() or not y[held].any():
        return Boosted(-20.0)
    xt, yt = x[~held], y[~held].astype(float)
    model = Boosted(float(np.log(yt.mean() / (1 - yt.mean()))))
    for _ in range(rounds):
        p = model.predict(xt)
        model.trees.append(_grow(xt, yt - p, p * (1 - p), np.arange(len(yt)), depth, rate))
    p, yh = model.predict(x[held]), y[held]
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(yh[order]) / np.arange(1, len(yh) + 1)
    fine = np.flatnonzero(good >= precision)
    if not len(fine):
        model.threshold = 2.0
        return model
    # between the last score taken and the next lower one, so that rounding does not matter
    last = p[order][fine[-1]]
    lower = p[p < last - 1e-9]
    model.threshold = float(max(0.5 - 1e-9, (last + (lower.max() if len(lower) else 0.0)) / 2))
    return model


def _features(text: Column, c: Column) -> list[Column]:
    """Format and context of one candidate; none looks at which pattern it is."""
    t = c["text"]
    before = F.lower(F.substring(text, F.greatest(c["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(c["start"], F.lit(CONTEXT)).cast("int")))
    after = F.substring(text, (c["end"] + 1).cast("int"), F.lit(1))
    n = F.char_length(t)
    count = lambda p: (n - F.char_length(F.regexp_replace(t, p, ""))).cast("double")
    flag = lambda b: F.coalesce(b.cast("double"), F.lit(0.0))
    return [
        n.cast("double"),
        count("[0-9]"),
        count("[A-Za-z]"),
        count(r"[\x20]"),
        count("[.]"),
        count("[-]"),
        count("[()]"),
        flag(t.rlike("@|at")),
        flag(before.rlike(r"tel|phone|fax|call|mobile|contact")),
        flag(before.rlike(r"mail|write to|iban|account|card|ssn|passport|tax")),
        flag(before.rlike(r"version|page|chapter|isbn|total|no\.|figure")),
        flag(before.rlike(r"[\x20(:]$") | (F.char_length(before) == 0)),
        flag(after.rlike(r"[^0-9A-Za-z]") | (after == "")),
    ]


def _proposals(text: Column) -> Column:
    """What the generators propose beside the base kinds."""
    def tag(kind: str, pattern: str) -> Column:
        return F.transform(matches(text, pattern), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))

    return F.concat(*(tag(k, p) for k, p in EXTRA.items()))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _instead(email: Column, phone: Column, pick: Column) -> tuple[Column, Column]:
    """Other forms of an address or number (null where there is none), and
    look-alikes that are no personal data; ``pick`` chooses among them."""
    spelled = [(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), (" at ", " dot ")]
    address = F.element_at(F.array(*(F.replace(F.replace(email, F.lit("@"), F.lit(at)), F.lit("."), F.lit(dot)) for at, dot in spelled)), (F.pmod(pick, F.lit(len(spelled))) + 1).cast("int"))
    bare = F.regexp_replace(phone, r"^\+[0-9]{1,3}[\x20.-]?", "")
    digits = F.regexp_replace(bare, "[^0-9]", "")
    parted = lambda c: F.concat_ws(c, F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 20))
    number = F.element_at(F.array(bare, parted("-"), parted("."), parted(" ")), (F.pmod(F.shiftright(pick, 8), F.lit(4)) + 1).cast("int"))
    part = lambda k, n: F.pmod(F.shiftright(pick, k), F.lit(n)).cast("string")
    two = lambda k, n: F.lpad(part(k, n), 2, "0")
    plain = [
        F.concat(F.lit("20"), two(3, 30), F.lit("-"), two(9, 12), F.lit("-"), two(15, 28)),
        F.concat(F.lit("version "), two(3, 12), F.lit("."), two(9, 30), F.lit("."), two(15, 99)),
        F.concat(F.lit("pages "), two(3, 90), F.lit("-"), two(9, 99)),
        F.concat(F.lit("total "), two(3, 99), F.lit("."), two(9, 99)),
        F.concat(two(3, 24), F.lit("/"), two(9, 12), F.lit("/"), F.lit("19"), two(15, 99)),
    ]
    return F.coalesce(address, number), F.element_at(F.array(*plain), (F.pmod(F.shiftright(pick, 20), F.lit(len(plain))) + 1).cast("int"))


def labelled(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES) -> DataFrame:
    """(key, y, sure, f): features of proposals that are (1) and are not (0)
    personal data, from the sampled documents; ``key`` orders them, whatever the
    partitions.  What is proposed in a text as it is (not sure) counts as none,
    though some of it may be."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(sample_docs)
    some = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")  # bounded by sample_docs
    base = base_spans(F.col("text"))
    all_base = F.concat(*(F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for s in base.values()))
    some = materialise(some.select("doc_id", "text", F.get(base["email"], F.lit(0)).alias("email"), F.get(base["phone"], F.lit(0)).alias("phone"), all_base.alias("base")))
    pick = F.abs(F.xxhash64(F.lit(21), "doc_id", "text"))
    known = some.filter("email is not null or phone is not null")
    # a document with both gives the one that its hash says
    use_email = F.col("phone").isNull() | (F.col("email").isNotNull() & (F.pmod(F.shiftright(pick, 33), F.lit(2)) == 0))
    span = F.when(use_email, F.col("email")).otherwise(F.col("phone"))
    other, plain = _instead(F.when(use_email, F.col("email.text")), F.when(~use_email, F.col("phone.text")), pick)
    known = known.select("doc_id", "text", span.alias("span"), F.explode(F.array(F.struct(F.lit(1).alias("y"), other.alias("put")), F.struct(F.lit(0).alias("y"), plain.alias("put")))).alias("v"))
    before, after = F.expr("substring(text, 1, int(span.start))"), F.expr("substring(text, int(span.end) + 1)")
    known = known.select("doc_id", "v.y", F.concat(before, F.col("v.put"), after).alias("text"), F.array(F.struct(F.col("span.start").alias("start"), (F.col("span.start") + F.char_length("v.put")).alias("end"))).alias("at"))
    # of rewritten texts the proposals at the place count, of texts as they are those off all base spans
    as_is = some.select("doc_id", F.lit(0).alias("y"), "text", F.lit(None).cast("array<struct<start:long,end:long>>").alias("at"), "base")
    both = known.withColumn("base", F.lit(None).cast("array<struct<start:long,end:long>>")).unionByName(as_is)
    both = both.select("doc_id", "y", "text", "at", "base", F.explode(_proposals(F.col("text"))).alias("x"))
    x = F.col("x")
    fits = F.when(F.col("at").isNotNull(), F.exists("at", lambda s: _overlap(x, s))).otherwise(~F.exists("base", lambda s: _overlap(x, s)))
    key = F.xxhash64(F.lit(13), "doc_id", "y", "x.kind", "x.start", "text")
    rows = both.filter(fits).select(key.alias("key"), "y", F.col("at").isNotNull().alias("sure"), F.array(*_features(F.col("text"), x)).alias("f"))
    return rows.orderBy("key", "y", "f").limit(sample_candidates)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES) -> Boosted:
    """Fit the trees on at most ``sample_candidates`` proposals of at most
    ``sample_docs`` documents, both chosen by hashes, so that the model does not
    depend on how the rows are partitioned.  The reliable negatives among the
    proposals of texts as they are come from a first fit."""
    rows = labelled(docs, sample_docs, sample_candidates).collect()
    if not rows:
        return Boosted(-20.0)
    x, y, sure = np.array([r["f"] for r in rows], float), np.array([r["y"] for r in rows]), np.array([r["sure"] for r in rows])
    first = boost(x, y)
    if not first.trees:
        return first
    # proposals that look like the rewritten ones to a first model may be
    # personal data, and teach nothing
    score = first.predict(x)
    keep = sure | (score < np.quantile(score[y == 1], 0.02))
    return boost(x[keep], y[keep])


def find_pii(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind,start,end,base>>.

    Base spans come first, kind by kind, then by start; further candidates
    follow where no base span overlaps them and the trees' score reaches the
    threshold.  A null text counts as empty; repeated rows are searched each;
    texts of any length are searched whole; further columns are ignored; an
    empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.concat(*(_tagged(k, s, True) for k, s in base_spans(text).items()))
    out = docs.select("doc_id", "text", base.alias("base"))
    if model is None or not model.trees or model.threshold > 1:
        return out.select("doc_id", F.col("base").alias("spans"))
    out = out.withColumn("more", _proposals(text))
    clear = F.filter("more", lambda c: ~F.exists("base", lambda b: _overlap(c, b)))
    chosen = F.filter(clear, lambda c: model.column(_features(text, c)) >= model.threshold)
    plain = F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.lit(False).alias("base")))
    return out.select("doc_id", F.concat("base", F.when(F.size("more") > 0, plain).otherwise(F.array().cast("array<struct<kind:string,start:long,end:long,base:boolean>>"))).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets."""
    init = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        return F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.aggregate(ordered, init, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.greatest(F.char_length(text), F.lit(1)))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the SHA-256 of the base spans, and all spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
