"""Toxicity as severity grades: a cumulative-link (ordinal) regression on sparse text.

P(grade > k) = sigmoid(s - t_k): one weight per feature, shared by all thresholds, and
ordered thresholds t_0 < t_1 < ... The expected severity is the sum of these
probabilities; a document is called toxic when P(grade > 0) reaches one half.

Features are presences: hashed words and hashed 5-byte pieces of words, A-Z lower-cased,
of which the ``FEATURES`` that tell grades apart best are kept. The model is fitted on a
bounded sample of labelled rows: at most ``PER_CLASS`` rows toxic and as many not, by
smallest hash of the id. Where labels only say toxic or not, toxic rows are graded 1 or 2
by how much of their text consists of words that only toxic rows use (median split).
Every document is scored, row by row, without a shuffle; the model (at most ``FEATURES``
weights) is the only thing sent along.

Edge cases: a null or empty text has no features and gets the base severity; labels that
are null, or for unknown documents, are left out; with labels of one class only, nothing
is called toxic; repeated rows score alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, Hasher, list_array, slices, stage, word_bounds

BUCKETS = 1 << 22
FEATURES = 4096
PER_CLASS = 6000
PIECE = 5
#: A feature must occur in this many sampled documents.
LEAST_DOCS = 4

_SEPARATES = np.ones(256, dtype=bool)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _SEPARATES[_a:_b] = False


def hits(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word and piece of the buffer."""
    data = LOWER_AZ[data]
    hasher = Hasher(data)
    starts, ends, _ = word_bounds(data, offsets, _SEPARATES)
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_SEPARATES[data], out=inside[1:])
    cut = np.zeros(len(data) + 1, np.int64)
    cut[offsets] = 1
    cut = np.cumsum(cut)
    at = np.arange(max(0, len(data) - PIECE + 1))
    at = at[(inside[at + PIECE] - inside[at] == PIECE) & (cut[at + PIECE - 1] == cut[at])]
    where = np.concatenate((starts, at))
    # words end with a mark, so that a word of five bytes is not a piece
    hashed = np.concatenate((hasher.ranges(starts, ends) * np.uint64(3), hasher.ranges(at, at + PIECE)))
    return np.searchsorted(offsets, where, "right") - 1, (hashed >> np.uint64(40)).astype(np.int64) % BUCKETS


def _pairs(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, by document."""
    key = np.unique(doc * BUCKETS + bucket)
    return key // BUCKETS, key % BUCKETS


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in slices(batches):
        doc, bucket = _pairs(*hits(s.bytes, s.offsets))
        lists = list_array(bucket.astype(np.int32), np.bincount(doc, minlength=len(s)))
        yield pa.RecordBatch.from_arrays([s.columns[0], s.columns[1], lists], ["doc_id", "toxic", "features"])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, toxic, features`` of the sampled rows."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = [known.where(f"toxic {test}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for test in ("> 0", "<= 0")]
    # at most 2 * per_class rows
    ids = F.broadcast(ids[0].unionByName(ids[1]).withColumnRenamed("doc_id", "id_"))
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("id_")).select("doc_id", "toxic", "text")
    return rows.mapInArrow(_features, "doc_id long, toxic int, features array<int>")


def telling_features(sample: DataFrame, most: int = FEATURES) -> DataFrame:
    """``feature, clean, toxic`` (numbers of documents) of the most telling features."""
    size = sample.agg(F.count_if(F.col("toxic") > 0).alias("all_toxic"), F.count_if(F.col("toxic") <= 0).alias("all_clean"))
    counts = sample.select(F.explode("features").alias("feature"), "toxic").groupBy("feature")
    counts = counts.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean"))
    counts = counts.where(F.col("toxic") + F.col("clean") >= LEAST_DOCS).join(F.broadcast(size), F.lit(True))
    p, q = F.col("toxic") / F.greatest("all_toxic", F.lit(1)), F.col("clean") / F.greatest("all_clean", F.lit(1))
    pooled = (F.col("toxic") + F.col("clean")) / (F.col("all_toxic") + F.col("all_clean"))
    z = F.abs(p - q) / F.sqrt(pooled * (1 - pooled) + 1e-6)
    return counts.withColumn("z", z).orderBy(F.desc("z"), "feature").limit(most).select("feature", "clean", "toxic")


class OrdinalModel:
    """Shared weights and ordered thresholds over chosen features."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        order = np.argsort(features)
        self.features, self.weights, self.thresholds = features[order], weights[order], thresholds

    def place(self, buckets: np.ndarray) -> np.ndarray:
        """Place of each bucket among the features, -1 if it is none."""
        if not len(self.features):
            return np.full(len(buckets), -1)
        at = np.minimum(np.searchsorted(self.features, buckets), len(self.features) - 1)
        return np.where(self.features[at] == buckets, at, -1)

    def exceed(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k), one row per document."""
        at = self.place(bucket)
        doc, at = _pairs(doc[at >= 0], at[at >= 0])
        score = np.bincount(doc, weights=self.weights[at], minlength=n)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, rounds: int = 300, rate: float = 0.05, ridge: float = 1e-4):
    """Weights and thresholds by Adam steps on the ordinal likelihood.

    ``rows``: the feature places of each document. Thresholds stay ordered, as each is
    the one before plus a positive gap.
    """
    top = int(grades.max()) if len(grades) else 0
    if top == 0:
        return np.zeros(n_features), np.array([40.0])
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate(rows) if len(rows) else np.zeros(0, int)
    theta = np.concatenate((np.zeros(n_features), [0.0], np.zeros(top - 1)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, rounds + 1):
        weights, gaps = theta[:n_features], np.exp(theta[n_features + 1 :])
        cuts = theta[n_features] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(doc, weights=weights[at], minlength=len(rows))
        over = sigmoid(score[:, None] - cuts[None, :])
        edge = np.concatenate((np.ones((len(rows), 1)), over, np.zeros((len(rows), 1))), axis=1)
        here = np.arange(len(rows))
        p = np.maximum(edge[here, grades] - edge[here, grades + 1], 1e-12)
        slope = edge * (1 - edge)
        d_score = (slope[here, grades] - slope[here, grades + 1]) / p  # of the log likelihood
        d_cuts = np.zeros((len(rows), top))
        low, high = grades >= 1, grades < top
        d_cuts[here[low], grades[low] - 1] -= slope[here[low], grades[low]] / p[low]
        d_cuts[here[high], grades[high]] += slope[here[high], grades[high] + 1] / p[high]
        g_weights = np.bincount(at, weights=d_score[doc], minlength=n_features) / len(rows) - ridge * weights
        g_cuts = d_cuts.mean(axis=0)
        g_gaps = np.array([g_cuts[k + 1 :].sum() * gaps[k] for k in range(top - 1)])
        grad = np.concatenate((g_weights, [g_cuts.sum()], g_gaps))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n_features], theta[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(theta[n_features + 1 :]))))


def severity_grades(toxic: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """0 for clean rows; toxic rows get 1, or 2 when ``marked`` (their number of features
    that only toxic rows have) is above the median of toxic rows. Larger labels stay."""
    grades = np.maximum(toxic, 0).astype(int)
    if grades.max(initial=0) == 1:
        middle = np.median(marked[grades == 1])
        grades[(grades == 1) & (marked > middle)] = 2
    return grades


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most: int = FEATURES) -> OrdinalModel:
    sample = stage(labelled_sample(docs, labels, per_class), "toxic-sample")
    chosen = telling_features(sample, most).toPandas()  # at most ``most`` rows
    chosen = chosen.sort_values("feature").reset_index(drop=True)
    features = chosen["feature"].to_numpy(dtype=np.int64)
    only_toxic = (chosen["clean"] == 0).to_numpy()
    n = len(features)

    model = OrdinalModel(features, np.zeros(n), np.zeros(1))

    def chosen_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = [p[p >= 0] for p in (model.place(np.asarray(f.values, dtype=np.int64)) for f in batch.column(2))]
            lists = list_array(np.concatenate(places).astype(np.int32), [len(p) for p in places])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "toxic", "places"])

    def one_model(rows: pd.DataFrame) -> pd.DataFrame:
        """All sampled rows with their few chosen features: bounded by the sample."""
        rows = rows.sort_values("doc_id")
        places = [np.asarray(p, dtype=np.int64) for p in rows["places"]]
        marked = np.array([only_toxic[p].sum() for p in places], dtype=float)
        weights, cuts = fit_ordinal(places, severity_grades(rows["toxic"].to_numpy(), marked), n)
        return pd.DataFrame({"place": np.arange(n + len(cuts)), "value": np.concatenate((weights, cuts))})

    reduced = sample.mapInArrow(chosen_places, "doc_id long, toxic int, places array<int>")
    fitted = reduced.groupBy().applyInPandas(one_model, "place int, value double").orderBy("place").toPandas()["value"].to_numpy()
    if not len(fitted):
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.array([40.0]))
    return OrdinalModel(features, fitted[:n], fitted[n:])


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """One row per document: ``doc_id, severity`` (expected grade), ``p_toxic, grade``
    (most likely), ``toxic``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            over = model.exceed(*hits(s.bytes, s.offsets), len(s))
            edge = np.concatenate((np.ones((len(s), 1)), over, np.zeros((len(s), 1))), axis=1)
            grade = np.argmax(edge[:, :-1] - edge[:, 1:], axis=1)
            yield pa.RecordBatch.from_arrays(
                [s.columns[0], pa.array(over.sum(axis=1)), pa.array(over[:, 0].copy()), pa.array(grade.astype(np.int32)), pa.array(over[:, 0] >= 0.5)],
                ["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most: int = FEATURES) -> DataFrame:
    return score(docs, fit(docs, labels, per_class, most))
