"""A bounded sample of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import among, fold, shared_folder, stored

#: Bytes of text that a sample holds, at most.
BYTES = 32 << 20


def sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, held_out: int = 0, folds: int = 5, most: int = BYTES) -> DataFrame:
    """doc_id, text and label of at most `rows` labelled documents and `most` bytes, chosen by a hash of doc_id.

    Only ids whose crc32 modulo `folds` is not `held_out`, with a non-null label. An id that is
    labelled more than once has its largest label; of repeated documents one is taken. Texts are
    whole; in the hash's order, one that has no room left is passed over.
    """
    spark = documents.sparkSession
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(fold(F.col("doc_id"), folds) != held_out)
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    order = (F.xxhash64(F.lit(label), "doc_id"), F.col("doc_id"))
    ids = ids.orderBy(*order).limit(rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id")  # at most `rows` ids
    found = stored(found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label")), shared_folder(spark, "sample"))
    room, taken = most, []
    for r in found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(*order).collect():  # at most `rows` pairs of numbers
        if r["size"] <= room:
            room -= r["size"]
            taken.append((r["doc_id"],))
    return among(found, spark.createDataFrame(taken, "doc_id long"), "doc_id")
