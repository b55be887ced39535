"""Toxicity grades by cumulative-link ordinal regression.

One weight vector is shared by ordered thresholds: the log odds that a
document's grade is above j are ``w·x - threshold[j]``.  The score is the
expected grade.  The labels say toxic or not; how severe a toxic document is,
grade 1 or 2, is set by a model fitted on other documents.  Every hashed word
or word beginning that enough sampled documents hold is a feature, whichever
class holds it; an L1 penalty chooses among them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialise, own_name

WORD = re.compile(r"[^\W\d_]+")
PREFIX = 5
BUCKETS = 1 << 22
#: bounds of the labelled sample that the model is fitted on, and of its features
TOXIC_SAMPLE, CLEAN_SAMPLE, FEATURES = 2000, 4000, 20_000
#: a feature is in at least so many sampled documents
MIN_DOCUMENTS, MIN_SHARE = 4, 0.003
PENALTY, CHANCE, RIDGE = 0.01, 3.5, 1e-4
REJECT_AT = 0.5
_seen: dict[str, tuple[int, ...]] = {}


def _features_of(word: str) -> tuple[int, ...]:
    found = _seen.get(word)
    if found is None:
        if len(_seen) > 500_000:
            _seen.clear()
        keys = [word] if len(word) <= PREFIX else [word, word[:PREFIX] + "*"]
        found = _seen[word] = tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) % BUCKETS for k in keys)
    return found


def features(text: str | None) -> Counter:
    """Hashed words and word beginnings of the whole text → counts."""
    out: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for f in _features_of(word):
            out[f] += n
    return out


@dataclass
class OrdinalModel:
    weights: dict[int, float]
    thresholds: list[float]

    def above(self, counts: list[tuple[int, int]] | Counter) -> list[float]:
        """P(grade > j) for each threshold."""
        items = counts.items() if isinstance(counts, dict) else counts
        s = sum(self.weights[f] * float(np.log1p(n)) for f, n in sorted(items) if f in self.weights)
        return [float(1 / (1 + np.exp(-np.clip(s - t, -40, 40)))) for t in self.thresholds]

    def of_text(self, text: str | None) -> list[float]:
        w, own = self.weights, Counter()
        for word, n in Counter(WORD.findall((text or "").lower())).items():
            for f in _features_of(word):
                if f in w:
                    own[f] += n
        return self.above(own)


def _solve(row: np.ndarray, col: np.ndarray, val: np.ndarray, k: int, grade: np.ndarray, rounds: int, penalty: np.ndarray, ridge: float) -> tuple[np.ndarray, list[float]]:
    """Weights of the k columns and the two thresholds, by accelerated proximal
    gradient steps on standardised values, which are never made dense; the
    penalties are the L1 norm and half the squared norm of those weights.  No
    gradient of a weight exceeds 1, so columns with a larger penalty stay out."""
    able = np.flatnonzero(penalty < 1)
    if len(able) < k:
        at = np.full(k, -1)
        at[able] = np.arange(len(able))
        use = at[col] >= 0
        part, thresholds = _solve(row[use], at[col[use]], val[use], len(able), grade, rounds, penalty[able], ridge)
        w = np.zeros(k)
        w[able] = part
        return w, thresholds
    n = len(grade)
    mean = np.bincount(col, val, k) / n
    std = np.sqrt(np.maximum(np.bincount(col, val * val, k) / n - mean * mean, 1e-6))
    times = lambda w: np.bincount(row, val * (w / std)[col], n) - (mean / std) @ w
    back = lambda g: (np.bincount(col, val * g[row], k) - mean * g.sum()) / std / n
    v, top = np.cos(np.arange(k)), 0.0  # any start, the same each time
    for _ in range(15):
        v = back(times(v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    step = 1 / (0.5 * max(1.1 * top, 1.0) + ridge)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    share = [np.clip((grade > j).mean(), 0.5 / n, 1 - 0.5 / n) for j in (0, 1)]
    cuts = [float(np.log((1 - p) / p)) for p in share]
    theta = np.array([cuts[0], np.log(max(cuts[1] - cuts[0], 1e-3))])  # the second is the log of the gap
    w = look = np.zeros(k)
    pace = 1.0
    for _ in range(rounds):
        s = times(look)
        c = np.array([theta[0], theta[0] + np.exp(theta[1])])
        a = [sig(s - x) for x in c]
        d = [x * (1 - x) for x in a]
        p = np.maximum(np.select([grade == 0, grade == 1], [1 - a[0], a[0] - a[1]], a[1]), 1e-12)
        up = np.select([grade == 0, grade == 1], [-d[0], d[0] - d[1]], d[1]) / p
        c0 = np.where(grade == 0, d[0], np.where(grade == 1, -d[0], 0)) / p
        c1 = np.where(grade == 1, d[1], np.where(grade == 2, -d[1], 0)) / p
        moved = look + step * (back(up) - ridge * look)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        look, w, pace = new + (pace - 1) / faster * (new - w), new, faster
        theta = theta + np.clip([2 * (c0.sum() + c1.sum()) / n, 2 * (c1.sum() * np.exp(theta[1])) / n], -0.5, 0.5)
    shift = float((mean / std) @ w)
    return w / std, [float(theta[0]) + shift, float(theta[0] + np.exp(theta[1])) + shift]


def _choosing(row: np.ndarray, col: np.ndarray, val: np.ndarray, k: int, toxic: np.ndarray, penalty: float) -> np.ndarray:
    """The L1 penalty of each column: ``penalty`` for one whose own correlation
    with the toxic label is ``CHANCE`` standard errors, of either sign, and the
    less, with the fourth power, the further it is from chance."""
    n, rate = len(toxic), toxic.mean()
    mean = np.bincount(col, val, k) / n
    std = np.sqrt(np.maximum(np.bincount(col, val * val, k) / n - mean * mean, 1e-6))
    z = np.sqrt(n / (rate * (1 - rate))) * (np.bincount(col, val * toxic[row], k) / n - mean * rate) / std
    return penalty * (CHANCE / np.maximum(np.abs(z), 1e-2)) ** 4


def fit(row: np.ndarray, feature: np.ndarray, count: np.ndarray, toxic: np.ndarray, rounds: int = 200, penalty: float = PENALTY, ridge: float = RIDGE) -> OrdinalModel:
    """Fit on sparse counts (row, feature, count) and a toxic label a row.

    All features take part; an adaptive L1 penalty chooses among them.  The
    grade of a toxic document is set by a model that has not seen it: each half
    of the rows is scored by a fit of the other half, and those above the
    median of their half are grade 2."""
    toxic = np.asarray(toxic) > 0
    if not len(toxic) or not toxic.any() or toxic.all():
        return OrdinalModel({}, [40.0, 41.0])
    names, col = np.unique(feature, return_inverse=True)
    k, val, grade = len(names), np.log1p(count.astype(float)), toxic.astype(int)
    half = np.arange(len(toxic)) % 2 == 0
    for seen in (half, ~half):
        own = ~seen & toxic
        if not toxic[seen].any() or toxic[seen].all() or not own.any():
            continue
        mine, at = seen[row], np.cumsum(seen) - 1
        part = (at[row[mine]], col[mine], val[mine], k)
        w, _ = _solve(*part, 2 * toxic[seen].astype(int), rounds // 2, _choosing(*part, toxic[seen], penalty), ridge)
        s = np.bincount(row, val * w[col], len(toxic))
        grade[own] += s[own] > np.median(s[own])
    w, thresholds = _solve(row, col, val, k, grade, rounds, _choosing(row, col, val, k, toxic, penalty), ridge)
    chosen = np.flatnonzero(w)
    return OrdinalModel({int(names[i]): float(w[i]) for i in chosen}, thresholds)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, toxic, text) → (id, toxic, feature, count), a document at a time."""
    kinds = [("id", pa.int64()), ("toxic", pa.int32()), ("f", pa.int32()), ("n", pa.int32())]
    for b in batches:
        for i, g, text in zip(*(b.column(k) for k in range(3)), strict=True):
            found = features(text.as_py())
            m = len(found)
            cols = [[i.as_py()] * m, [g.as_py()] * m, list(found), list(found.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[x for x, _ in kinds])


def train(docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE, max_features: int = FEATURES) -> OrdinalModel:
    """Fit on at most the given numbers of labelled documents, chosen by a hash
    of the id, and on the ``max_features`` features that most of them hold.

    A document labelled twice counts as toxic if any label says so; null ids
    and null labels are left out; of rows that repeat an id, the text with the
    smallest hash is taken.  Nothing depends on how the rows are partitioned.
    """
    known = labels.filter("doc_id is not null and toxic is not null")
    one = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    by_hash = (F.xxhash64(F.lit(5), "id"), F.col("id"))
    picked = one.filter("toxic = 1").orderBy(*by_hash).limit(toxic_sample).union(one.filter("toxic = 0").orderBy(*by_hash).limit(clean_sample))
    # the sample of labels is bounded by the two parameters
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(picked), "id")
    own = own.groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    counts = materialise(own.mapInArrow(_count_batches, "id long, toxic int, f int, n int"))
    held = counts.groupBy("f").agg(F.count(F.lit(1)).alias("docs"))
    toxic = {r.id: r.toxic for r in counts.select("id", "toxic").distinct().collect()}  # at most the sample
    least = max(MIN_DOCUMENTS, int(MIN_SHARE * len(toxic)))
    kept = held.filter(F.col("docs") >= least).orderBy(F.desc("docs"), "f").limit(max_features)
    # at most max_features; the entries are at most the sample times that
    found = counts.join(F.broadcast(kept.select("f")), "f").select("id", "f", "n").toArrow().sort_by([("id", "ascending"), ("f", "ascending")])
    ids = np.array(sorted(toxic), np.int64)
    row, feature, count = (found.column(c).to_numpy() for c in ("id", "f", "n"))
    return fit(np.searchsorted(ids, row), feature, count, np.array([toxic[i] for i in ids.tolist()], int))


def severity(model: OrdinalModel, text: str | Column = "text") -> Column:
    """struct(p_above_0, p_above_1, expected_severity) of a text column."""
    @F.pandas_udf("p_above_0 double, p_above_1 double, expected_severity double")
    def score(texts: pd.Series) -> pd.DataFrame:
        p = np.array([model.of_text(t) for t in texts]).reshape(len(texts), 2)
        return pd.DataFrame({"p_above_0": p[:, 0], "p_above_1": p[:, 1], "expected_severity": p.sum(axis=1)})

    return score(F.col(text) if isinstance(text, str) else text)


def score_documents(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT) -> DataFrame:
    """doc_id, p_above_0, p_above_1, expected_severity, grade, toxic.

    A null or empty text scores as a text without features; a long text is
    scored whole; rows that repeat, or share an id, are scored each; further
    columns are ignored; an empty table gives an empty result.
    """
    s = docs.select("doc_id", severity(model).alias("s"))
    e = F.col("s.expected_severity")
    grade = (F.col("s.p_above_0") >= 0.5).cast("int") + (F.col("s.p_above_1") >= 0.5).cast("int")
    return s.select("doc_id", F.round("s.p_above_0", 6).alias("p_above_0"), F.round("s.p_above_1", 6).alias("p_above_1"), F.round(e, 6).alias("expected_severity"), grade.alias("grade"), (e >= reject_at).alias("toxic"))


def keep_clean(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of ``docs`` below the threshold, with their own columns."""
    name = own_name(docs, "severity")
    return docs.withColumn(name, severity(model)["expected_severity"]).filter(F.col(name) < reject_at).select(*(docs[c] for c in docs.columns))
