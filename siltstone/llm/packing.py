"""Packing by non-negative least squares: length combinations that fill a window, then the rest."""

from __future__ import annotations

import zlib
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import BROADCAST_IDS, shared_folder, slices, small_batches, stored
from siltstone.llm.tokens import Encoder

WINDOW = 2048
END_ID = 1
#: Lengths that combinations of three, and of four, are drawn from: the most frequent. This bounds the
#: patterns, not the pieces: what patterns leave is packed greedily.
FREQUENT = {3: 160, 4: 32}
STEPS = 300


def combinations(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Length combinations that fill the window exactly: all pairs, and threes and fours of frequent lengths."""
    window = len(histogram)
    have = np.flatnonzero(histogram)
    out = {(int(a), window - int(a)) for a in have if a <= window - a and histogram[window - a]}
    order = have[np.argsort(-histogram[have], kind="stable")]
    for depth, most in FREQUENT.items():
        for head in combinations_with_replacement(sorted(order[:most].tolist()), depth - 1):
            last = window - sum(head)
            if 0 < last < window and histogram[last]:
                out.add(tuple(sorted((*head, last))))
    return sorted(out)


def least_squares(histogram: np.ndarray, patterns: list[tuple[int, ...]], steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, A the lengths that a pattern uses.

    Multiplicative updates x *= A'h / A'Ax, which never leave the non-negative orthant.
    """
    width = max(map(len, patterns))
    slot = np.array([(*p, *[0] * (width - len(p))) for p in patterns])
    real = slot > 0
    h = histogram.astype(float)
    x = np.where(real, h[slot], np.inf).min(1) / width + 1e-9
    target = np.where(real, h[slot], 0).sum(1)
    for _ in range(steps):
        made = np.bincount(slot.ravel(), (x[:, None] * real).ravel(), len(h))
        x *= target / np.maximum(np.where(real, made[slot], 0).sum(1), 1e-12)
    return x


def greedy(left: np.ndarray):
    """Yield (lengths, repeats) of exact fillings of the window by lengths that are left, longest first.

    A filling begins with the longest length and takes the longest that fits until one or two more
    fill it. It is repeated as often as its lengths allow, so there are few. Lengths that begin no
    filling are left; left is changed.
    """
    window = len(left)
    for n in range(window - 1, 0, -1):
        while left[n]:
            free, lengths, room = left.copy(), [n], window - n
            free[n] -= 1
            while room:
                if free[room]:
                    lengths.append(room)
                    break
                first = np.flatnonzero(free[:room])
                use = np.minimum(free[first], free[room - first])
                use[2 * first == room] //= 2
                if len(use) and use.max() > 0:
                    x = int(first[use.argmax()])
                    lengths += [x, room - x]
                    break
                if not len(first):
                    lengths = []
                    break
                lengths.append(int(first[-1]))
                free[first[-1]] -= 1
                room -= int(first[-1])
            if not lengths:
                break
            used, times = np.unique(lengths, return_counts=True)
            count = int((left[used] // times).min())
            left[used] -= count * times
            yield tuple(sorted(lengths)), count


def plan(histogram: np.ndarray) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go. histogram[n]: pieces of n ids, n from 1 to below the window.

    Returns rows (length, first rank, end rank, sequence, offset, stream) in order, and the number
    of sequences. A piece of a length has a rank; ranks of a row go to successive sequences at the
    same offset, or, where stream >= 0, one after another from that position of a chain of
    sequences, cut at their ends.
    """
    left, rows, sequences = histogram.copy(), [], 0
    left[0] = 0
    taken = np.zeros_like(left)
    patterns = combinations(left)
    if patterns:
        want = np.floor(least_squares(left, patterns) + 0.5).astype(np.int64)
        for k in np.argsort(-want, kind="stable"):
            lengths, repeats = np.unique(patterns[k], return_counts=True)
            count = int(min(want[k], (left[lengths] // repeats).min()))
            if count <= 0:
                continue
            offset = 0
            for n in reversed(patterns[k]):
                rows.append((n, taken[n], taken[n] + count, sequences, offset, -1))
                taken[n] += count
                left[n] -= count
                offset += n
            sequences += count
    # what rounding leaves: whole pieces fill windows exactly where they can, then a chain
    for lengths, count in greedy(left):
        offset = 0
        for n in reversed(lengths):
            rows.append((n, taken[n], taken[n] + count, sequences, offset, -1))
            taken[n] += count
            offset += n
        sequences += count
    position = 0
    for n in np.flatnonzero(left)[::-1]:
        rows.append((int(n), taken[n], taken[n] + left[n], sequences, 0, position))
        position += int(n * left[n])
    sequences += -(-position // len(histogram))
    return np.array(sorted(rows), np.int64).reshape(-1, 6), int(sequences)


def _tokenised(path: str, window: int):
    def run(batches):
        encoder, part = Encoder.of(path), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        seen: dict[int, int] = {}
        row = windows = 0
        for batch in (part_ for whole in batches for part_ in slices(whole, "text")):
            out = []
            texts = (t.as_py() for t in batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                n, step = len(ids) // 4, 4 * window
                rest = n % window
                rank = seen.get(rest, 0)
                seen[rest] = rank + 1
                crcs = [zlib.crc32(ids[k : k + step]) for k in range(0, len(ids), step)]
                cut = 4 * (n - rest)
                out.append((doc_id, part, row, n, rest, rank, windows, crcs, ids[:cut], ids[cut:]))
                row += 1
                windows += n // window
            columns = list(zip(*out, strict=True)) if out else [()] * 10
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "part", "row", "n", "rest", "rank", "windows", "crcs", "full", "tail"])

    return run


TOKENISED = "doc_id long, part long, row long, n long, rest long, rank long, windows long, crcs array<long>, full binary, tail binary"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _placed(rows: np.ndarray, window: int, sequences: int, cut: bool):
    """Pieces of documents: full windows, and the rest by the plan. cut: documents whose rest is cut, with its ids."""
    keys = (rows[:, 0] << 44) + rows[:, 1] if len(rows) else np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            get = {name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("part", "n", "rest", "place", "windows")}
            doc, crcs = batch.column("doc_id").to_pylist(), batch.column("crcs").to_pylist()
            line = np.searchsorted(keys, (get["rest"] << 44) + get["place"], "right") - 1
            out = []
            for i in range(len(doc)):
                n, rest = int(get["n"][i]), int(get["rest"][i])
                if not cut:
                    base = sequences + (int(get["part"][i]) << 36) + int(get["windows"][i])
                    for k in range(n // window):
                        out.append((doc[i], k * window, window, crcs[i][k], n, base + k, 0))
                if not rest:
                    continue
                _, first, _, sequence, offset, stream = map(int, rows[line[i]])
                step = int(get["place"][i]) - first
                if stream < 0:
                    if not cut:
                        out.append((doc[i], n - rest, rest, crcs[i][-1], n, sequence + step, offset))
                    continue
                at = stream + step * rest
                room = window - at % window
                if rest <= room:
                    if not cut:
                        out.append((doc[i], n - rest, rest, crcs[i][-1], n, sequence + at // window, at % window))
                elif cut:
                    ids = batch.column("tail")[i].as_py()
                    out.append((doc[i], n - rest, room, zlib.crc32(ids[: 4 * room]), n, sequence + at // window, at % window))
                    out.append((doc[i], n - rest + room, rest - room, zlib.crc32(ids[4 * room :]), n, sequence + at // window + 1, 0))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def tokenised(documents: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """One row per document with its ids (an end id follows): those of full windows, and the rest."""
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    codec = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    try:
        return stored(rows.mapInArrow(_tokenised(vocabulary, window), TOKENISED), shared_folder(spark, "packing") + "/tokenised")
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", codec)


def packed(documents: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """Pieces of documents in sequences of at most `window` ids.

    Full windows of a document are sequences of their own. The rests are counted by length (a
    histogram of fewer rows than the window); least squares on the driver gives repeat counts of
    length combinations that fill a sequence exactly. What rounding leaves fills sequences exactly too,
    greedily, longest first; the last of it follows in a chain that is cut at sequence
    ends, so only the chain's last sequence has padding.

    Null and empty texts are the end id alone. Repeated rows and null ids are documents of their
    own. Other columns are ignored; an empty table has no pieces. sequence_id is unique, not dense.
    """
    spark = documents.sparkSession
    docs = tokenised(documents, vocabulary, window)
    histogram = np.zeros(window, np.int64)
    counts = docs.groupBy("part", "rest").agg((F.max("rank") + 1).alias("count"))
    for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("count").alias("count")).collect():  # fewer rows than the window
        histogram[r.rest] = r["count"]
    rows, sequences = plan(histogram)
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "rest", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = docs.drop("full", "tail").join(bases, ["part", "rest"]).withColumn("place", F.col("rank") + F.col("base"))
    whole = ranked.mapInArrow(_placed(rows, window, sequences, False), PIECE)

    streams = rows[rows[:, 5] >= 0]
    if not len(streams):
        return whole
    table = spark.createDataFrame([(int(r[0]), int(r[1]), int(r[5])) for r in streams], "rest long, first long, stream long")
    at = F.expr(f"(stream + (place - first) * rest) % {window}")
    torn = ranked.join(F.broadcast(table), "rest").where("place >= first").where(at + F.col("rest") > window).drop("first", "stream")
    many = -(-int(((streams[:, 2] - streams[:, 1]) * streams[:, 0]).sum()) // window)  # the end of a sequence cuts one document at most
    torn = F.broadcast(torn) if many <= BROADCAST_IDS else torn
    torn = docs.select("part", "row", "tail").join(torn, ["part", "row"])
    return whole.union(torn.mapInArrow(_placed(rows, window, sequences, True), PIECE))
