"""Toxicity: subword-bag embeddings, averaged, under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BLANKS, U64, fold, mix64, slices, small_batches, text_bytes
from siltstone.llm.labelled import sample
from siltstone.llm.quality_classifier import logistic

SIZES = (3, 4, 5)
BUCKETS = 1 << 17
DIMENSIONS = 8
#: Words of a bag. A text is cut in half bags; each two neighbours are a bag, and the worst bag counts.
BAG = 4
LABELLED = 3000
THRESHOLD = 0.5
#: Steps over all bags, then rounds of steps over the bags that are worst so far.
FIRST_STEPS = 15
ROUNDS = 8
STEPS = 30
RATE = 0.3
#: Every so many-th sampled text is kept for the final logistic curve.
KEPT_OUT = 4

#: Bytes as the subwords see them: A-Z lower-cased, blanks and common punctuation a space.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[65:91] = np.arange(97, 123)
_SEEN[list(BLANKS + b".,;:?\"()[]{}")] = 32
#: Bytes that are a space too where they begin or end a word, but not inside one.
_EDGE = np.zeros(256, bool)
_EDGE[list(b"!#*")] = True


class Subwords:
    """Words of rows of text, and the buckets of each word's character n-grams with its bounds."""

    def __init__(self, column: pa.Array):
        data, at = text_bytes(column)
        rows = len(at) - 1
        place = np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(at))
        self.bytes = np.full(len(data) + rows + 1, 32, np.uint8)
        self.bytes[place] = _SEEN[data]
        self._cut()
        edge = np.flatnonzero(_EDGE[self.bytes])
        if len(edge):  # those with nothing else before, or after, them in their word
            letters = np.concatenate(([0], np.cumsum((self.bytes != 32) & ~_EDGE[self.bytes])))
            word = np.searchsorted(self.start, edge, "right") - 1
            outer = (letters[edge] == letters[self.start[word]]) | (letters[self.stop[word]] == letters[edge])
            self.bytes[edge[outer]] = 32
            self._cut()
        self.first = np.searchsorted(self.start, at + np.arange(rows + 1))

    def _cut(self) -> None:
        solid = self.bytes != 32
        self.start = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
        self.stop = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1

    def grams(self, n: int) -> np.ndarray:
        """The bucket of the n bytes from each position on; a word's begin at its space and end at its space."""
        count = max(len(self.bytes) - n + 1, 0)
        key = np.full(count, n, U64)
        for k in range(n):
            key = key * U64(0x100000001B3) + self.bytes[k : count + k]
        return (mix64(key) >> U64(64 - 17)).astype(np.int32)

    def spans(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last position of each word's n-grams."""
        low = self.start - 1
        return low, np.maximum(self.stop + 2 - n, low)

    def means(self, values: np.ndarray) -> np.ndarray:
        """For each word, the mean over its subwords of values[bucket]."""
        total, count = np.zeros(len(self.start)), np.zeros(len(self.start))
        for n in SIZES:
            sums = np.concatenate(([0.0], np.cumsum(values[self.grams(n)], dtype=float)))
            low, high = self.spans(n)
            high = np.minimum(high, len(sums) - 1)
            low = np.minimum(low, high)
            total += sums[high] - sums[low]
            count += high - low
        return total / np.maximum(count, 1)


def bag_sums(first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, one past the last, row) of each bag, and the mean of `words` over each."""
    half = BAG // 2
    size = np.diff(first)
    blocks = np.maximum(-(-size // half) - 1, (size > 0).astype(size.dtype))
    row = np.repeat(np.arange(len(size)), blocks)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = first[row] + inner * half
    high = np.minimum(low + BAG, first[row + 1])
    sums = np.concatenate(([0.0], np.cumsum(words)))
    return low, high, row, (sums[high] - sums[low]) / np.maximum(high - low, 1)


class Training:
    """The distinct words of the sample with their subwords, and its bags over those words."""

    def __init__(self, texts: list[str]):
        subwords = Subwords(pa.array(texts, pa.string()))
        raw = subwords.bytes.tobytes()
        known: dict[bytes, int] = {}
        self.word = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(subwords.start.tolist(), subwords.stop.tolist(), strict=True)], np.int64)
        own = Subwords(pa.array([w.decode("utf-8", "replace") for w in known], pa.string()))
        buckets, rows = [], []
        for n in SIZES:
            grams = own.grams(n)
            low, high = own.spans(n)
            high = np.minimum(high, len(grams))
            size = np.maximum(high - low, 0)
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            buckets.append(grams[np.repeat(low, size) + inner])
            rows.append(np.repeat(np.arange(len(size)), size))
        self.bucket, self.owner = np.concatenate(buckets), np.concatenate(rows)
        self.words = len(known)
        self.share = 1 / np.maximum(np.bincount(self.owner, minlength=self.words), 1)
        self.low, self.high, self.row, _ = bag_sums(subwords.first, np.zeros(len(self.word)))

    def part(self, bags: np.ndarray) -> Part:
        """The model's inputs for some bags: their words, and those words' subwords."""
        size = self.high[bags] - self.low[bags]
        at = np.concatenate(([0], np.cumsum(size)))
        words = self.word[np.repeat(self.low[bags] - at[:-1], size) + np.arange(at[-1])]
        used = np.zeros(self.words, bool)
        used[words] = True
        some = used[self.owner]
        return Part(np.repeat(np.arange(len(bags)), size), words, size, self.bucket[some], self.owner[some], self.share)


class Part(NamedTuple):
    bag: np.ndarray
    word: np.ndarray
    size: np.ndarray
    bucket: np.ndarray
    owner: np.ndarray
    share: np.ndarray

    def logits(self, z: np.ndarray) -> np.ndarray:
        """The mean over each bag of its words' means over subwords of z."""
        per_word = np.bincount(self.owner, z[self.bucket], len(self.share)) * self.share
        return np.bincount(self.bag, per_word[self.word], len(self.size)) / self.size

    def gradient(self, bags: np.ndarray) -> np.ndarray:
        """The gradient by z, from that by the bags' logits."""
        per_word = np.bincount(self.word, (bags / self.size)[self.bag], len(self.share)) * self.share
        return np.bincount(self.bucket, per_word[self.owner], BUCKETS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """(z, slope, offset): z is each subword's embedding times the difference of the softmax columns.

    All bags of clean texts are clean. Of a toxic text at first all bags count as toxic, then the one
    that the model finds worst, against the worst of clean texts and as many others. Embeddings and
    softmax weights are learned together by Adagrad. The logistic curve of a text's worst bag is from
    texts kept out of that.
    """
    if len(set(labels.tolist())) < 2:
        return None
    kept_out = np.arange(len(labels)) % KEPT_OUT == 0
    if len(set(labels[~kept_out].tolist())) < 2 or len(set(labels[kept_out].tolist())) < 2:
        kept_out[:] = False
    learned = labels[~kept_out]
    data = Training([t for t, out in zip(texts, kept_out, strict=True) if not out])
    if not len(data.row):
        return None
    random = np.random.default_rng(11)
    embeddings = random.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    softmax = random.normal(0, 0.5, (DIMENSIONS, 2))
    bias = np.zeros(2)
    grown = [np.full_like(x, 1e-8) for x in (embeddings, softmax, bias)]
    toxic = learned[data.row] == 1
    every = data.part(np.arange(len(data.row)))
    for turn in range(ROUNDS + 1):
        if turn:
            logit = every.logits(embeddings @ (softmax[:, 1] - softmax[:, 0]))
            worst = np.full(len(learned), -np.inf)
            np.maximum.at(worst, data.row, logit)
            top = np.flatnonzero(logit >= worst[data.row])
            clean = np.flatnonzero(~toxic)
            hard = clean[np.argsort(-logit[clean])[: 2 * len(learned)]]
            chosen = np.unique(np.concatenate((top, hard, random.choice(clean, min(len(clean), 2 * len(learned)), replace=False))))
            part, target = data.part(chosen), toxic[chosen].astype(float)
        else:
            part, target = every, toxic.astype(float)
        scale = np.where(target > 0, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1))
        for _ in range(STEPS if turn else FIRST_STEPS):
            column = softmax[:, 1] - softmax[:, 0]
            off = (_sigmoid(part.logits(embeddings @ column) + bias[1] - bias[0]) - target) * scale
            by_z = part.gradient(off)
            by_column = embeddings.T @ by_z
            for x, g, total in zip((embeddings, softmax, bias), (np.outer(by_z, column), np.stack((-by_column, by_column), 1), np.array([-off.sum(), off.sum()])), grown, strict=True):
                total += g * g
                x -= RATE * g / np.sqrt(total)
    z = (embeddings @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    margin = worst_bags(pa.array([t for t, out in zip(texts, kept_out, strict=True) if out or not kept_out.any()], pa.string()), z)
    some = np.isfinite(margin)
    own = labels[kept_out] if kept_out.any() else labels
    return z, *logistic(margin[some], own[some])


def worst_bags(column: pa.Array, z: np.ndarray) -> np.ndarray:
    """The greatest logit of a bag of each row; minus infinity for a row without words."""
    subwords = Subwords(column)
    _, _, row, mean = bag_sums(subwords.first, subwords.means(z))
    worst = np.full(len(subwords.first) - 1, -np.inf)
    np.maximum.at(worst, row, mean)
    return worst


def probabilities(column: pa.Array, z: np.ndarray, slope: float, offset: float) -> np.ndarray:
    """The probability of the worst bag of each row; 0 for a row without words."""
    worst = worst_bags(column, z)
    some = np.isfinite(worst)
    return np.where(some, _sigmoid(slope * np.where(some, worst, 0) + offset), 0.0)


def scored(documents: DataFrame, labels: DataFrame, rows: int = LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of documents (doc_id, text).

    Learns from at most `rows` labelled documents (and labelled.BYTES of text) outside the held-out fifth
    (crc32(doc_id) modulo 5 is 0). A text's score is the greatest over its bags of 4 words, so a few words in a long text
    count. Texts without words, null ones too, score 0, as does every text if only one label is known.
    A null id counts as held out. Repeated rows are scored each; other columns are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    found = sample(documents, labels, "toxic", rows).orderBy("doc_id").select("label", "text").toArrow()
    model = fit([t or "" for t in found.column("text").to_pylist()], found.column("label").to_numpy().astype(int))
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                p = probabilities(batch.column("text"), *shared.value) if shared.value else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows_ = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows_.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
