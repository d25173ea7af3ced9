"""What the corpus operators share: a folder all executors see, and numpy over Arrow text buffers.

Word and shingle code works on the bytes of a whole Arrow batch at once: ASCII classes are byte
classes in UTF-8, so no string is ever decoded. Batches are cut by bytes, so memory stays bounded
whatever the lengths of the rows.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that are worked on at once; temporary arrays take some 50 times that.
CHUNK_BYTES = 1 << 19
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
#: Ids that are broadcast, at most (24 bytes each); more go by a shuffle.
BROADCAST_IDS = 2_000_000
SHINGLE = 5
#: Bytes that end a word: space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local master (one machine) gets a temporary folder; a cluster is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "siltstone-checkpoints")
    return f"{root.rstrip('/')}/siltstone/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Arrow batches of so many rows and bytes at most, so that long texts don't add up in a worker; and the package for workers.

    The result is lazy and Spark reads these settings as it runs, so they stay in the session; smaller
    ones that it has are left alone.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def among(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows whose key is among ids (a stored table of that column), or is not (left_anti).

    ids are broadcast only if they are counted and few.
    """
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id is in no fold and counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, a permutation of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def series64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        out = np.full(size, base, dtype=U64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
        if size > 4 * CHUNK_BYTES:  # a very long text: don't keep its table
            return _powers.pop(base)
    return _powers[base]


def byte_class(blanks: bytes) -> np.ndarray:
    """A table of 256 flags: False for the bytes that separate words."""
    table = np.ones(256, dtype=bool)
    table[list(blanks)] = False
    return table


def byte_values(seed: int, lower: bool = True) -> np.ndarray:
    """A random value for each byte; A-Z have those of a-z if lower."""
    table = series64(256, seed)
    if lower:
        table[65:91] = table[97:123]
    return table


SPACED = byte_class(BLANKS)
LOWERED = byte_values(17)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def slices(batch: pa.RecordBatch, *columns: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold `most` bytes at most (one longer text is a part of its own)."""
    at = sum(text_bytes(batch.column(c))[1] for c in columns)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """The words of each row of a text column: byte bounds, row, and a 64-bit hash of each."""

    def __init__(self, column: pa.Array, wordly: np.ndarray = SPACED, values: np.ndarray = LOWERED):
        self.data, self.at = text_bytes(column)
        n = len(self.data)
        is_word = wordly[self.data]
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        ends = is_word.copy()
        ends[:-1] &= ~is_word[1:]
        edges = self.at[(self.at > 0) & (self.at < n)]
        begins[edges] |= is_word[edges]
        ends[edges - 1] |= is_word[edges - 1]
        self.start = np.flatnonzero(begins)
        self.stop = np.flatnonzero(ends) + 1
        #: first word of each row, and one past the last row's last
        self.first = np.searchsorted(self.start, self.at)
        sums = np.zeros(n + 1, U64)
        np.cumsum(values[self.data] * powers(BASE, n + 1)[:n], out=sums[1:])
        raw = (sums[self.stop] - sums[self.start]) * powers(BASE_INVERSE, n + 1)[self.start]
        self.hash = mix64(raw + (self.stop - self.start).astype(U64))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))


_ODD = series64(2 * SHINGLE + 2, 99) | U64(1)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles, in order, and where each row's begin (with the end).

    A row with one to four words has one: its whole sequence. A row without words has none.
    """
    count = np.diff(words.first)
    total = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(count.dtype))
    out_at = np.concatenate(([0], np.cumsum(total)))
    out = np.empty(int(out_at[-1]), U64)
    n = len(words.hash)
    if n >= SHINGLE:
        every = np.zeros(n - SHINGLE + 1, U64)
        for k in range(SHINGLE):
            every += words.hash[k : n - SHINGLE + 1 + k] * _ODD[k]
        every = mix64(every)
    for short in np.flatnonzero((count > 0) & (count < SHINGLE)):
        h = words.hash[words.first[short] : words.first[short + 1]]
        out[out_at[short]] = mix64((h * _ODD[SHINGLE : SHINGLE + len(h)]).sum(dtype=U64, keepdims=True) + U64(len(h)))[0]
    long = count >= SHINGLE
    if long.any():
        keep = np.ones(n, bool)
        last = words.first[1:][count > 0]
        for k in range(1, SHINGLE):
            back = last - k
            keep[back[back >= 0]] = False
        row_short = np.repeat(~long, count)
        keep[row_short] = False
        mask = np.zeros(len(out), bool)
        starts = out_at[:-1][long]
        marks = np.zeros(len(out) + 1, np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + total[long], -1)
        mask = np.cumsum(marks[:-1]) > 0
        out[mask] = every[keep[: n - SHINGLE + 1]]
    return out, out_at


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of one text, sorted."""
    return np.unique(shingles(Words(pa.array([text or ""], pa.string())))[0])


def int_list(flat: np.ndarray, size: int, kind: pa.DataType = pa.int64()) -> pa.ListArray:
    """Rows of `size` values each, as a list column."""
    at = np.arange(0, len(flat) + 1, size, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, kind))
