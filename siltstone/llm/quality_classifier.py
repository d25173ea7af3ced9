"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators are scaled by the classes' log-count ratios, then a linear hinge-loss model is fitted
by dual coordinate descent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import U64, Words, fold, mix64, slices, small_batches
from siltstone.llm.labelled import sample

WORD_BUCKETS = 1 << 17
SHAPE_BUCKETS = 1 << 12
SHAPE_SIZES = (1, 2, 3, 4)
#: Labelled documents that are learned from.
LABELLED = 6000
THRESHOLD = 0.3
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 20
FOLDS = 3

#: Bytes by shape: lower case and bytes of other letters are a, capitals A, digits 0; others stay.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
#: what stands for a word that repeats the one before it
_REPEATED = U64(0x51ED270B7A3F9C11)


def indicators(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indicators of each row and where each row's begin (with the end).

    Word unigrams and bigrams, in which a word equal to the one before it is a mark of repetition,
    have WORD_BUCKETS buckets; n-grams of byte shapes have SHAPE_BUCKETS after those.
    """
    words = Words(column)
    rows = len(words.at) - 1
    row = words.rows()
    token = words.hash.copy()
    joined = row[1:] == row[:-1]
    token[1:][joined & (words.hash[1:] == words.hash[:-1])] = _REPEATED
    pair = mix64(token[:-1] * U64(0x9E3779B97F4A7C15) + token[1:])[joined] if len(token) else token
    parts = [(row.astype(np.int64) << 17) | (token >> U64(47)).astype(np.int64)]
    if len(token) > 1:
        parts.append((row[1:][joined].astype(np.int64) << 17) | (pair >> U64(47)).astype(np.int64))
    packed = np.unique(np.concatenate(parts))
    shape = _SHAPE[words.data].astype(np.uint32)
    byte_row = np.repeat(np.arange(rows), np.diff(words.at))
    present = np.zeros(rows * SHAPE_BUCKETS, bool)
    for n in SHAPE_SIZES:
        count = len(shape) - n + 1
        if count <= 0:
            continue
        key = np.full(count, n, np.uint32)
        for k in range(n):
            key = (key + shape[k : count + k]) * np.uint32(0x9E3779B1)
            key ^= key >> np.uint32(15)
        inside = byte_row[:count] == byte_row[n - 1 :]
        present[(byte_row[:count] * SHAPE_BUCKETS + (key >> np.uint32(20)))[inside]] = True
    shapes = np.flatnonzero(present)
    both_row = np.concatenate((packed >> 17, shapes >> 12))
    both = np.concatenate((packed & (WORD_BUCKETS - 1), (shapes & (SHAPE_BUCKETS - 1)) + WORD_BUCKETS))
    order = np.argsort(both_row, kind="stable")
    return both[order].astype(np.int32), np.searchsorted(both_row[order], np.arange(rows + 1))


def log_count_ratio(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """For each indicator, the log of its smoothed share in class 1 over that in class 0."""
    size = WORD_BUCKETS + SHAPE_BUCKETS
    counts = [np.full(size, SMOOTHING), np.full(size, SMOOTHING)]
    for doc, label in zip(docs, labels, strict=True):
        counts[int(label)][doc] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(docs: list[np.ndarray], scales: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the L2-regularised hinge loss, by dual coordinate descent; rows have unit length.

    Each row's dual value lies between 0 and its cost. The last weight is the bias. Each class has the
    same total cost.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    cost = COST * len(y) / (2 * np.maximum([(y < 0).sum(), (y > 0).sum()], 1))[(y > 0).astype(int)]
    w, alpha = np.zeros(len(scales) + 1), np.zeros(len(y))
    rows = []
    for doc in docs:
        x = scales[doc]
        rows.append((np.append(doc, len(scales)), np.append(x / max(np.sqrt(x @ x), 1e-9), 1.0)))
    norm = np.array([x @ x for _, x in rows])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            new = min(max(alpha[i] - (y[i] * (w[at] @ x) - 1) / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
    return w


def margins(flat: np.ndarray, at: np.ndarray, scales: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The model's margin of each row of indicators."""
    scaled = np.append(scales[flat], 0.0)
    sums = np.concatenate(([0.0], np.cumsum(scaled * np.append(weights[flat], 0.0))))
    norms = np.concatenate(([0.0], np.cumsum(scaled * scaled)))
    return (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(norms[at[1:]] - norms[at[:-1]], 1e-18)) + weights[-1]


def logistic(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve of the margins: damped Newton steps on smoothed targets.

    Margins are centred between the classes first; each class has the same weight in that.
    """
    ones = labels == 1
    low, high = np.median(margin[~ones]) if (~ones).any() else margin.min(), np.median(margin[ones]) if ones.any() else margin.max()
    centre, spread = (low + high) / 2, max(abs(high - low) / 2, 1e-6)
    target = np.where(ones, (ones.sum() + 1) / (ones.sum() + 2), 1 / ((~ones).sum() + 2))
    x, beta = np.stack(((margin - centre) / spread, np.ones_like(margin)), 1), np.array([1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        v = x @ b
        return float((np.logaddexp(0, v) - target * v).sum() + 1e-2 * (b**2).sum())

    now = loss(beta)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 2e-2 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 2e-2 * beta)
        while (after := loss(beta - step)) > now and np.abs(step).max() > 1e-8:
            step = step / 2
        if np.abs(step).max() < 1e-7:
            break
        beta, now = beta - step, after
    slope = max(beta[0], 1e-3) / spread
    return float(slope), float(beta[1] - slope * centre)


def fit(docs: list[np.ndarray], labels: np.ndarray) -> tuple | None:
    """(scales, weights, slope, offset); None if a class has no rows. The curve is of margins of rows left out."""
    if len(set(labels.tolist())) < 2:
        return None
    left_out = np.zeros(len(labels))
    for k in range(FOLDS):
        own = np.arange(len(labels)) % FOLDS == k
        rest = np.flatnonzero(~own)
        if len(set(labels[rest].tolist())) < 2 or not own.any():
            continue
        scales = log_count_ratio([docs[i] for i in rest], labels[rest])
        weights = dual_descent([docs[i] for i in rest], scales, labels[rest])
        mine = [docs[i] for i in np.flatnonzero(own)]
        left_out[own] = margins(np.concatenate(mine), np.concatenate(([0], np.cumsum([len(d) for d in mine]))), scales, weights)
    scales = log_count_ratio(docs, labels)
    return scales, dual_descent(docs, scales, labels), *logistic(left_out, labels)


def _listed(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            flat, at = indicators(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], names=["label", "indicators"])


def scored(documents: DataFrame, labels: DataFrame, rows: int = LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of documents (doc_id, text).

    Learns from at most `rows` labelled documents (and labelled.BYTES of text) outside the held-out fifth
    (crc32(doc_id) modulo 5 is 0). score is the calibrated probability of label 1, of the whole text; null is empty. Without
    labels of both classes every score is the share of label 1 (0.5 without labels). A null id counts
    as held out. Repeated rows are scored each; other columns are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    found = sample(documents, labels, "quality", rows).orderBy("doc_id").select("label", "text").mapInArrow(_listed, "label int, indicators array<int>").toArrow()
    y = found.column("label").to_numpy().astype(int)
    docs = [np.asarray(x.values) for x in found.column("indicators")]
    model = fit(docs, y)
    shared = spark.sparkContext.broadcast(model if model else float(y.mean()) if len(y) else 0.5)

    def score(batches):
        model = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                if isinstance(model, float):
                    p = np.full(batch.num_rows, model)
                else:
                    scales, weights, slope, offset = model
                    p = 1 / (1 + np.exp(-np.clip(slope * margins(*indicators(batch.column("text")), scales, weights) + offset, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows_ = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows_.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
