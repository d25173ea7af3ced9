"""Benchmark decontamination: size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import U64, Words, mix64, shingles, slices, small_batches
from siltstone.llm.near_dups import _SHIFT, _pi, signatures

COORDINATES = 64
#: Numerator and denominator of the least share of an item's shingles that a document must hold.
HELD = (75, 100)
#: Each size class takes items up to so many times the size of the class below.
GROWTH = 1.5
#: Bytes of item texts in an index, which is built on the driver and broadcast (some 60 MB); documents are read
#: once for each index.
BLOCK_BYTES = 16 << 20


class ItemIndex:
    """Items by size class: sorted MinHash coordinates of each, and the full shingle sets.

    A class takes items of at most U distinct shingles, U growing by GROWTH. Documents are cut in
    blocks of U shingles, and two neighbouring blocks are a window, so a passage of an item lies
    whole in some window of at most 2 U. There the Jaccard similarity is at least
    0.75 q / (2 U + 0.25 q) > 0.23 for an item of q > U / GROWTH shingles that is held to 75 %; one
    agreeing coordinate of 64 makes a candidate, so a window misses with probability below 1e-7.
    """

    def __init__(self, ids: list, texts: list):
        flat, at = shingles(Words(pa.array([t or "" for t in texts], pa.string())))
        self.sets, self.ids, classes = [], [], {}
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if b > a:
                own = np.unique(flat[a:b])
                limit = 4
                while limit < len(own):
                    limit = int(limit * GROWTH)
                classes.setdefault(limit, []).append(len(self.sets))
                self.sets.append(own)
                self.ids.append(ids[i])
        self.classes = []
        for limit, members in sorted(classes.items()):
            full = np.concatenate([self.sets[m] for m in members])
            sizes = np.array([len(self.sets[m]) for m in members])
            table = signatures(full, np.concatenate(([0], np.cumsum(sizes))), COORDINATES)
            order = np.argsort(table, axis=0, kind="stable")
            self.classes.append((limit, np.array(members)[order].T.copy(), np.take_along_axis(table, order, 0).T.copy()))

    def candidates(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (row, item) pairs, packed as row * items + item, that share a coordinate in a window."""
        sizes = np.diff(at)
        if not len(flat) or not self.sets:
            return np.zeros(0, np.int64)
        sigma = (mix64(flat + U64(0xA0761D6478BD642F)) >> U64(32)).astype(np.uint32)
        cuts = []
        for limit, _, _ in self.classes:
            blocks = -(-sizes // limit)
            row = np.repeat(np.arange(len(sizes)), blocks)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            cuts.append((at[row] + inner * limit, row, np.append(row[1:] == row[:-1], False)))
        x, tmp, found = np.empty_like(sigma), np.empty_like(sigma), []
        for k in range(COORDINATES):
            np.add(sigma, np.uint32((k * int(_SHIFT)) & 0xFFFFFFFF), out=x)
            _pi(x, tmp)
            for (starts, row, joined), (_, members, table) in zip(cuts, self.classes, strict=True):
                low = np.minimum.reduceat(x, starts)
                low[:-1] = np.where(joined[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                left = np.searchsorted(table[k], low, "left")
                hit = np.flatnonzero(table[k][np.minimum(left, len(table[k]) - 1)] == low)
                if len(hit):
                    right = np.searchsorted(table[k], low[hit], "right")
                    count = right - left[hit]
                    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    item = members[k][np.repeat(left[hit], count) + inner]
                    found.append(np.unique(np.repeat(row[hit], count) * len(self.sets) + item))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def matches(self, batch: pa.RecordBatch) -> list[tuple[int, int, int, int]]:
        """(row, item, shared, size) of the items that rows of the batch hold."""
        flat, at = shingles(Words(batch.column("text")))
        out, last, own = [], -1, None
        for packed in self.candidates(flat, at):
            row, item = divmod(int(packed), len(self.sets))
            if row != last:
                last, own = row, np.unique(flat[at[row] : at[row + 1]])
            need = self.sets[item]
            place = np.minimum(np.searchsorted(own, need), len(own) - 1)
            shared = int((own[place] == need).sum())
            if HELD[1] * shared >= HELD[0] * len(need):
                out.append((row, item, shared, len(need)))
        return out


def _blocks(benchmark: DataFrame) -> Iterator:
    """Broadcast indexes of the items; the driver holds one at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // BLOCK_BYTES)
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k).collect()
        yield spark.sparkContext.broadcast(ItemIndex([r.item_id for r in rows], [r.text for r in rows]))


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item: each document row that holds an item.

    Shingles are 5 words, lower-cased; sets are distinct. An item is held if at least 75 % of its
    shingles are in the document, counted on full sets. Texts of one to four words are one
    shingle, so a short item is held by documents of just those words. Null and blank texts match
    nothing. Repeated rows give repeated results; a null id stays null. Other columns are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_shared long, n_item long"
    out = spark.createDataFrame([], schema)
    for shared in _blocks(benchmark):

        def search(batches, shared=shared):
            index = shared.value
            for whole in batches:
                for batch in slices(whole, "text"):
                    hits = index.matches(batch)
                    row = pa.array([h[0] for h in hits], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(row), pa.array([index.ids[h[1]] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int64())],
                        names=["doc_id", "item_id", "n_shared", "n_item"],
                    )

        out = out.union(rows.mapInArrow(search, schema))
    return out


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents, all columns, that hold no item (see contaminated)."""
    small_batches(documents.sparkSession)
    for shared in _blocks(benchmark):

        def keep(batches, shared=shared):
            for whole in batches:
                for batch in slices(whole, "text"):
                    clean = np.ones(batch.num_rows, bool)
                    clean[[h[0] for h in shared.value.matches(batch)]] = False
                    yield batch.filter(pa.array(clean))

        documents = documents.mapInArrow(keep, documents.schema)
    return documents
