"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - threshold_k): one weight vector over hashed text features is
shared by all grades, and the thresholds are ordered.  It is fitted on a bounded sample of rated
documents; every document is scored.  Spark hashes the sample and screens the buckets; only what
the screened buckets hold reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import materialise

#: Hash buckets of words and their beginnings, and dense features of the text's form after them.
BUCKETS, FORMS = 1 << 17, 10
#: Value of a bucket that a text has.
WORD = 0.5
#: Lengths in bytes of the beginnings that are features beside the whole word.
STEMS = (4, 5, 6, 7)
#: A bucket is fitted if it is in so many documents and its mean grade is more standard errors off
#: than the sum of so many and what the largest of so many tries reaches by chance.
LEAST_DOCS, MORE_Z = 5, 0.3
#: At most so many rated documents are fitted on, whatever the number of ratings.
SAMPLE = 10_000


@dataclass(frozen=True)
class OrdinalModel:
    """Shared ``weights`` and increasing ``thresholds``; grade k or more where w.x exceeds thresholds[k - 1]."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns; never increasing along a row."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))


def hashes(words: set[bytes]) -> np.ndarray:
    """Buckets of the words and their beginnings; a beginning is hashed as one number of up to eight bytes."""
    whole = np.fromiter(map(crc32, words), np.uint64, len(words))
    first = np.array(list(words), "S8").view("<u8")
    starts = np.concatenate([first[first >> np.uint64(8 * k) > 0] & np.uint64((1 << 8 * k) - 1) for k in STEMS]) * np.uint64(0x9E3779B97F4A7C15)
    return np.concatenate((whole, starts >> np.uint64(32))).astype(np.int64) % BUCKETS


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's different words and their beginnings, and ten features of its form; both empty for no words."""
    words = (text or b"").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    n = len(words)
    distinct = {w.lower().strip(b".,;:!?\"'()") for w in words}
    lines = text.split(b"\n")
    upper = sum(map(bytes.isupper, words)) / n
    symbols = sum(text.count(c) for c in b"#*$%&|<>") / n
    form = [upper, min(symbols, 3.0), text.count(b"!") / n, len(distinct) / n, len(text) / n / 10, np.log1p(n) / 10, (len(lines) - len(set(lines))) / len(lines), sum(text.count(d) for d in b"0123456789") / len(text), n < 50, 1.0]
    return np.unique(hashes(distinct)), np.array(form, dtype=float)


def told_buckets(n_docs: np.ndarray, graded: np.ndarray, n: int, mean: float, sd: float) -> np.ndarray:
    """Buckets that tell of the grade: their documents' mean grade is further off than chance would have any of them.

    Of k tries the largest of standard normal numbers is about sqrt(2 ln k); so the bar follows
    the number of buckets that enough documents have, and with it the size of the sample.
    """
    tried = n_docs >= LEAST_DOCS
    off = (graded - n_docs * mean) / np.sqrt(np.maximum(n_docs * (1 - n_docs / max(n, 1)), 1e-9)) / max(sd, 1e-9)
    bar = np.sqrt(2 * np.log(max(int(tried.sum()), 2))) + MORE_Z
    return np.flatnonzero(tried & (np.abs(off) >= bar))


def fit_ordinal(buckets: list[np.ndarray], forms: np.ndarray, grades: np.ndarray, levels: int, steps: int = 600, rate: float = 0.05, decay: float = 3e-4) -> OrdinalModel:
    """Maximum likelihood by Adam over the whole sample; fixed start and steps, so it is deterministic.

    With no rows all grades are equally likely.  Thresholds are a first one and positive gaps.
    """
    size = BUCKETS + FORMS
    rows = len(grades)
    if not rows:
        ks = np.arange(1, levels)
        return OrdinalModel(np.zeros(size), -np.log((levels - ks) / ks))
    every = np.arange(rows)
    own = np.concatenate((np.repeat(every, [len(b) for b in buckets]), np.repeat(every, FORMS)))
    at = np.concatenate((*buckets, np.tile(BUCKETS + np.arange(FORMS), rows))).astype(np.int64)
    val = np.concatenate((np.full(len(at) - rows * FORMS, WORD), forms.ravel()))
    theta = np.zeros(size + levels - 1)
    theta[size + 1 :] = np.log(1.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    share = np.bincount(grades, minlength=levels).astype(float)
    weight = (rows / np.maximum(share, 1) / (share > 0).sum())[grades] ** 0.5
    for step in range(1, steps + 1):
        w = theta[:size]
        cuts = theta[size] + np.concatenate(([0.0], np.cumsum(np.exp(theta[size + 1 :]))))
        score = np.bincount(own, val * w[at], rows)
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -60, 60)))
        full = np.hstack((np.ones((rows, 1)), tail, np.zeros((rows, 1))))
        p = np.maximum(full[every, grades] - full[every, grades + 1], 1e-12)
        slope = tail * (1 - tail)
        upper = np.hstack((np.zeros((rows, 1)), slope))[every, grades]
        lower = np.hstack((slope, np.zeros((rows, 1))))[every, grades]
        d_score = weight * (upper - lower) / p
        gw = np.bincount(at, val * d_score[own], size) / rows - decay * w
        gc = np.zeros(levels - 1)
        for k in range(levels - 1):
            gc[k] = -(weight * (upper * (grades == k + 1) - lower * (grades == k)) / p).sum() / rows
        gt = np.concatenate((gw, [gc.sum()], np.exp(theta[size + 1 :]) * gc[::-1].cumsum()[::-1][1:]))
        m, v = 0.9 * m + 0.1 * gt, 0.999 * v + 0.001 * gt * gt
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(theta[:size], theta[size] + np.concatenate(([0.0], np.cumsum(np.exp(theta[size + 1 :])))))


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, levels: int = 3, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` rated ids, those of smallest hash; repeated ratings count as the lowest.

    The sample's ids are broadcast (bounded by ``sample``).  Of an id with several texts the
    greatest is taken.  Features are computed where the documents are and written to the shared
    folder; counts and grades by bucket are summed by Spark (``BUCKETS`` rows), and only the
    buckets that tell of the grade come to the driver, where the model is fitted.
    """
    rated = ratings.select(F.col(id).alias("_fg_id"), grade.cast("int").alias("grade")).where(f"_fg_id is not null and grade between 0 and {levels - 1}")
    chosen = rated.groupBy("_fg_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("_fg_id"), "_fg_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x) for x in batch.column("t").to_pylist()]
            words, forms = [pa.array([r[k].astype(t).tobytes() for r in rows], pa.binary()) for k, t in ((0, "<i4"), (1, "<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("grade"), words, forms], names=["h", "grade", "b", "f"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, graded = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for b, g in zip(batch.column("b").to_pylist(), batch.column("grade").to_pylist()):
                at = np.frombuffer(b, "<i4")
                n[at] += 1
                graded[at] += g
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(graded[some])], names=["bucket", "n", "graded"])

    held = docs.select(F.col(id).alias("_fg_id"), F.col(text).cast("binary").alias("t")).join(F.broadcast(chosen), "_fg_id").where(F.length("t") > 0)
    held = held.groupBy("_fg_id").agg(F.max("t").alias("t"), F.max("grade").alias("grade")).select(F.xxhash64("_fg_id").alias("h"), "grade", "t")
    held = materialise(held.mapInArrow(run, "h long, grade int, b binary, f binary"), "features")
    n, mean, sd = held.where(F.length("f") > 0).agg(F.count("*"), F.coalesce(F.avg("grade"), F.lit(0.0)), F.coalesce(F.stddev_pop("grade"), F.lit(0.0))).first()
    n_docs, graded = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    sums = held.select("b", "grade").mapInArrow(count, "bucket long, n long, graded long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("graded").alias("graded")).toArrow()
    n_docs[sums["bucket"].to_numpy()], graded[sums["bucket"].to_numpy()] = sums["n"].to_numpy(), sums["graded"].to_numpy()
    told = told_buckets(n_docs, graded, n, mean, sd)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(b, "<i4") for b in batch.column("b").to_pylist()]
            words = pa.array([b[np.isin(b, told)].tobytes() for b in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("grade"), words, batch.column("f")], names=["h", "grade", "b", "f"])

    rows = sorted(held.where(F.length("f") > 0).mapInArrow(screen, held.schema).collect(), key=lambda r: r["h"])
    forms = np.frombuffer(b"".join(r["f"] for r in rows), "<f8").reshape(-1, FORMS)
    return fit_ordinal([np.frombuffer(r["b"], "<i4") for r in rows], forms, np.array([r["grade"] for r in rows], dtype=np.int64), levels)


def raw_score(model: OrdinalModel, text: bytes | None) -> float:
    """w . x of a text, minus infinity for one without words."""
    bucket, form = features(text)
    return float(WORD * model.weights[bucket].sum() + model.weights[BUCKETS:] @ form) if len(form) else -np.inf


def score(docs: DataFrame, model: OrdinalModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id column, expected_grade, p_ge_1, p_ge_2, ...): one row per row; a text without words is of grade 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + FORMS numbers
    levels = len(model.thresholds)
    names = [f"p_ge_{k}" for k in range(1, levels + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = np.array([raw_score(m, x) for x in batch.column(1).to_pylist()], dtype=float)
            tails = m.tails(np.nan_to_num(s, neginf=-1e9))
            tails[np.isneginf(s)] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), *(pa.array(tails[:, k].copy()) for k in range(levels))], names=[id, "expected_grade", *names])

    kind = docs.schema[id].dataType.simpleString()
    out = docs.select(F.col(id), F.col(text).cast("binary").alias("_fg_text"))
    return out.mapInArrow(run, ", ".join([f"`{id}` {kind}", "expected_grade double", *(f"{n} double" for n in names)]))


def graded(labels: DataFrame) -> Column:
    """Grades from the labels: 0 of low quality, 1 good but toxic, 2 good."""
    return F.when(labels["quality"] == 0, 0).when(labels["toxic"] == 1, 1).when(labels["quality"] == 1, 2)


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Grades of all documents and ``kept``: P(highest grade) >= ``least``.

    Null, empty and blank texts are of grade 0 and not kept; repeated rows give equal results;
    null ids are scored; labels that are null are not fitted on; without labels every grade is
    equally likely; an empty table gives an empty one.
    """
    model = fit(docs, labels, graded(labels), id=id, text=text)
    return score(docs, model, id, text).withColumn("kept", F.col(f"p_ge_{len(model.thresholds)}") >= least)


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; texts are filtered where they are read, without a shuffle.

    Null, empty and blank texts go; repeated rows stay or go together; rows with a null id are
    judged like others; without labels every grade is equally likely and with three grades
    nothing is kept at ``least`` 0.5; an empty table gives an empty one.
    """
    model = fit(docs, labels, graded(labels), id=id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keep = []
            for x in batch.column(text).to_pylist():
                s = raw_score(m, x.encode() if x is not None else None)
                keep.append(s > -np.inf and float(m.tails(np.array([s]))[0, -1]) >= least)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
