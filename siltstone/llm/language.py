"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import U64, fold, mix64, slices, small_batches

SIZES = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: About so many labelled rows are learned from; their share is taken by a hash of the id.
LABELLED = 20_000
UNKNOWN = "und"

_tables: list = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 65,536: is it a letter, and its lower case."""
    if not _tables:
        chars = [chr(k) if not 0xD800 <= k < 0xE000 else " " for k in range(1 << 16)]
        lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], np.uint32)
        _tables.extend((np.array([c.isalpha() for c in chars]), lower))
    return _tables[0], _tables[1]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each character n-gram, its row, and whether a row has a letter.

    Letters are lower-cased, every run of other characters is one space, and rows begin and end
    with one. N-grams lie within a row and the space after it.
    """
    texts = [t or "" for t in texts]
    size = np.array([len(t) + 1 for t in texts])
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.append(np.repeat(np.arange(len(texts)), size), len(texts))
    is_letter, lower = _letters()
    low = np.minimum(points, 0xFFFF)
    letter, high = is_letter[low], points > 0xFFFF
    if high.any():  # beyond the table
        found, place = np.unique(points[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in found])[place]
    folded = np.where(letter, np.where(high, points, lower[low]), np.uint32(32))
    has_letter = np.bincount(row[letter], minlength=len(texts)) > 0
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1] | (row[1:] != row[:-1])
    folded, row = folded[keep].astype(U64), row[keep]
    buckets, rows = [], []
    for n in SIZES:
        if len(folded) < n:
            continue
        count = len(folded) - n + 1
        key = np.full(count, n, U64)
        for k in range(n):
            key = key * U64(0x100000001B3) + folded[k : count + k]
        # a row's last space is the next row's first: an n-gram may end there but not pass it
        inside = row[:count] == row[max(n - 2, 0) : max(n - 2, 0) + count]
        if n == 1:
            inside = folded != 32
        else:
            inside &= ~((row[n - 1 :] != row[:count]) & (folded[n - 1 :] != 32))
        buckets.append((mix64(key[inside]) >> U64(64 - 15)).astype(np.int32))
        rows.append(row[:count][inside])
    return np.concatenate(buckets), np.concatenate(rows), has_letter


def _counted(batches):
    totals: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole, "text"):
            langs = np.array(batch.column("lang").to_pylist(), object)
            bucket, row, _ = ngrams(batch.column("text").to_pylist())
            for lang in set(langs):
                own = bucket[(langs == lang)[row]]
                totals[lang] = totals.get(lang, 0) + np.bincount(own, minlength=BUCKETS)
    for lang, counts in totals.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(counts[some])], names=["lang", "bucket", "count"])


def share_below(rows: int, total: int) -> int | None:
    """The signed 64-bit value that a hash is below for `rows` of `total` rows; None for all of them."""
    return None if rows >= total else (rows << 64) // total - (1 << 63)


def fit(labelled: DataFrame, rows: int = LABELLED) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (buckets x languages), from rows with text and lang.

    About `rows` rows are used, chosen by a hash of doc_id. Counts are summed on the executors; the
    driver gets at most one row for each bucket and language.
    """
    labelled = labelled.where("text is not null and lang is not null")
    small_batches(labelled.sparkSession)
    share = share_below(rows, labelled.select("doc_id", "lang").count())
    if share is not None:  # rows without an id are chosen by their text
        labelled = labelled.where(F.xxhash64(F.lit("language"), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))) < share)
    counts = labelled.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_counted, "lang string, bucket long, count long")
    found = counts.groupBy("lang", "bucket").agg(F.sum("count").alias("count")).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        table[own["bucket"].to_numpy(), k] += own["count"].to_numpy()
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def predict(texts: list[str | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior; all languages are equally likely before."""
    bucket, row, has_letter = ngrams(texts)
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    totals = np.stack([np.bincount(row, logs[:, k][bucket], len(texts)) for k in range(len(langs))], 1)
    best = totals.argmax(1)
    odds = np.exp(totals - totals.max(1, keepdims=True))
    score = np.where(has_letter, 1 / odds.sum(1), 0.0)
    return [langs[k] if some else UNKNOWN for k, some in zip(best, has_letter, strict=True)], score


def _predictor(spark, model, result):
    """result(batch, languages, scores) of each part of a batch."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                lang, score = predict(batch.column("text").to_pylist(), *shared.value)
                yield result(batch, lang, score)

    return run


def identified(documents: DataFrame, held_out: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of documents (doc_id, text, lang).

    Learns from rows with a lang whose crc32(doc_id) modulo `folds` is not `held_out`. A text that is
    null or has no letter is `und` with score 0, as is every text if there is nothing to learn from.
    Ties go to the first language by name. Repeated rows are predicted each; a null id counts as
    remainder 0. Other columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    model = fit(rows.where(fold(F.col("doc_id"), folds) != held_out))
    extra = lambda batch, lang, score: pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
    run = _predictor(spark, model, extra)
    return rows.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def in_a_language(documents: DataFrame, least: float = 0.5, held_out: int = 2, folds: int = 4) -> DataFrame:
    """The rows of documents, all columns, whose language is known with at least this posterior."""
    spark = documents.sparkSession
    model = fit(documents.where(fold(F.col("doc_id"), folds) != held_out))

    def extra(batch, lang, score):
        return batch.filter(pa.array((np.array(lang) != UNKNOWN) & (score >= least)))

    return documents.mapInArrow(_predictor(spark, model, extra), documents.schema)
