"""Circulant MinHash near-duplicates: classes, links and components over 5-word shingles."""

from __future__ import annotations

from functools import partial
from itertools import count as counted

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import BROADCAST_IDS, U64, Words, among, int_list, mix64, shared_folder, shingles, slices, small_batches, stored

BANDS = 32
ROWS = 4
#: Numerator and denominator of the least Jaccard similarity of a link.
SIMILAR = (75, 100)
#: Coordinates that must agree in their low byte before texts are fetched: 5.3 standard deviations below
#: what a link at the least similarity has, so one in 10 million is missed.
AGREEING = 70
#: Edges that are joined in one task's memory (some 150 bytes each).
FOREST_EDGES = 1_000_000

_SHIFT = np.uint32(0x9E3779B1)


def _pi(x: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """The second permutation of 32-bit values, in place: xor-shifts and odd multipliers."""
    for shift, odd in ((16, 0x21F0AAAD), (15, 0xD35A2D97)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        np.multiply(x, np.uint32(odd), out=x)
    np.right_shift(x, np.uint32(15), out=tmp)
    return np.bitwise_xor(x, tmp, out=x)


def signatures(flat: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A (rows, size) uint32 matrix of circulant MinHash coordinates.

    sigma scatters each shingle once into [0, 2**32); pi is one permutation of that circle.
    Coordinate k is the least pi(sigma + k * shift): pi turned circularly by k steps, so two
    permutations make all coordinates. Each row of `at` must have a shingle.
    """
    sigma = (mix64(flat + U64(0xA0761D6478BD642F)) >> U64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, size), np.uint32)
    if not len(out):
        return out
    first, step = 0, 1 << 16
    while first < len(out):  # row blocks that fit the cache
        last = max(first + 1, int(np.searchsorted(at, at[first] + step, "right")) - 1)
        own = sigma[at[first] : at[last]]
        x, tmp, starts = np.empty_like(own), np.empty_like(own), at[first:last] - at[first]
        for k in range(size):
            np.add(own, np.uint32((k * int(_SHIFT)) & 0xFFFFFFFF), out=x)
            out[first:last, k] = np.minimum.reduceat(_pi(x, tmp), starts)
        first = last
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A (rows, bands) int64 matrix of bucket keys; the band is part of the key."""
    key = np.zeros((len(signature), bands), U64) + np.arange(1, bands + 1, dtype=U64)
    for r in range(rows):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + signature[:, r::rows][:, :bands].astype(U64))
    return key.view(np.int64)


def _sets(flat: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [np.unique(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _describe(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = _sets(*shingles(Words(batch.column("text"))))
            size = np.array([len(s) for s in sets], np.int64)
            keys = np.zeros((2, len(sets)), U64)
            for i, s in enumerate(sets):
                if len(s):
                    keys[0, i], keys[1, i] = mix64(s).sum(dtype=U64), mix64(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
            some = size > 0
            bands, sketch = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), BANDS * ROWS), np.uint8)
            if some.any():
                full = np.concatenate([s for s in sets if len(s)])
                signature = signatures(full, np.concatenate(([0], np.cumsum(size[some]))), BANDS * ROWS)
                bands[some], sketch[some] = band_keys(signature), signature.astype(np.uint8)
            at = pa.py_buffer(np.arange(0, sketch.size + 1, BANDS * ROWS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), int_list(bands.ravel(), BANDS), pa.Array.from_buffers(pa.binary(), len(sets), [None, at, pa.py_buffer(sketch)])],
                names=["doc_id", "n_shingles", "key_a", "key_b", "bands", "sketch"],
            )


def described(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set, the bucket keys and the coordinates' low bytes, for every row."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_describe, "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>, sketch binary")


def _agreeing(batches):
    for batch in batches:
        own, lead = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("sketch", "lead_sketch"))
        yield batch.select(["id", "lead"]).filter(pa.array((own == lead).sum(1) >= AGREEING, pa.bool_()))


def paired(rows: DataFrame, pairs: DataFrame, folder: str) -> DataFrame:
    """The rows whose doc_id is in stored (id, lead) pairs. Their ids are written and counted only if they may be too many to broadcast."""
    ids = pairs.select(F.explode(F.array("id", "lead")).alias("doc_id")).distinct()
    if 2 * pairs.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), "doc_id", "left_semi")
    return among(rows, stored(ids, folder), "doc_id")


def promising(pairs: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """Those stored (id, lead) pairs whose sizes and coordinates allow a link. classes: doc_id, n_shingles, sketch."""
    own = paired(classes.select("doc_id", "n_shingles", "sketch"), pairs, f"{folder}-promising-ids")
    both = pairs.join(own.toDF("id", "n", "sketch"), "id").join(own.toDF("lead", "lead_n", "lead_sketch"), "lead")
    least, most = SIMILAR
    close = both.where(f"least(n, lead_n) * {most} >= greatest(n, lead_n) * {least}").select("id", "lead", "sketch", "lead_sketch")
    return stored(close.mapInArrow(_agreeing, "id long, lead long").distinct(), f"{folder}-promising")


def _verify(batches):
    known: tuple = (None, None)
    for whole in batches:
        for batch in slices(whole, "text", "lead_text"):
            flat, at = shingles(Words(batch.column("text")))
            left, lead, lead_texts = batch.column("id").to_pylist(), batch.column("lead").to_pylist(), batch.column("lead_text")
            keep = []
            for i in range(len(left)):
                own = np.unique(flat[at[i] : at[i + 1]])
                text = lead_texts[i].as_py() or ""
                if known[0] != text:
                    known = (text, np.unique(shingles(Words(pa.array([text], pa.string())))[0]))
                both = len(np.intersect1d(own, known[1], assume_unique=True))
                keep.append(both > 0 and SIMILAR[1] * both >= SIMILAR[0] * (len(own) + len(known[1]) - both))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(lead, pa.int64())], names=["id", "lead"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """Those stored (id, lead) pairs whose full shingle sets are similar enough. texts: doc_id, text.

    A lead with very many pairs is a skewed key of a plain join, which adaptive execution splits.
    Ids with several texts may give a pair more than once.
    """
    own = paired(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), pairs, f"{folder}-verified-ids")
    both = pairs.join(own.toDF("id", "text"), "id").join(own.toDF("lead", "lead_text"), "lead")
    return stored(both.select("id", "lead", "text", "lead_text").mapInArrow(_verify, "id long, lead long"), f"{folder}-verified")


def _rows_of_shingles(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = _sets(*shingles(Words(batch.column("text"))))
            size = np.array([len(s) for s in sets], np.int64)
            keys = np.array([mix64(s).sum(dtype=U64) if len(s) else 0 for s in sets], U64).view(np.int64)
            row = pa.array(np.repeat(np.arange(len(sets)), size))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), pa.array(np.repeat(size, size)), pa.array(np.repeat(keys, size)), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "n", "own", "shingle"])


def across(apart: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """(id, lead) pairs, the larger id first, of different components that may be links: every link is among them. apart: id, component.

    A link shares at least 75 % of either set. So a document that shares less with all others together
    has none; and of each two linked sets, the larger one's rarest quarter of shingles meets the
    smaller one's rarest seventh, in any one order of all shingles: here, by how many of these
    documents have it. The first shingle that they share leaves at most the shingles from there on; if those
    are too few, the pair is no link. Edits make shingles that no other copy has and that come first,
    so even in a large family of copies few pairs are left.
    """
    least, most = SIMILAR
    own = among(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), apart.select(F.col("id").alias("doc_id")), "doc_id")
    rows = own.mapInArrow(_rows_of_shingles, "id long, n long, own long, shingle long")
    count = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    one = Window.partitionBy("id", "own")
    order = one.orderBy("df", "shingle")
    rare = rows.join(count, "shingle").distinct().withColumn("common", F.count("*").over(one)).where(f"common * {most} >= n * {least}")
    rare = rare.withColumn("place", F.col("n") - F.col("common") + F.row_number().over(order)).where(f"place <= n - ceil(n * {least} / {most}) + 1")
    rare = stored(rare.select("shingle", "id", "n", "place").join(apart, "id"), f"{folder}-rare")
    short = rare.where(f"place <= n - ceil(n * {2 * least} / {least + most}) + 1")
    short = short.select("shingle", F.col("id").alias("lead"), F.col("n").alias("lead_n"), F.col("component").alias("lead_component"), (F.col("n") - F.col("place") + 1).alias("left"))
    close = f"least(n - place + 1, left) * {least + most} >= (n + lead_n) * {least}"
    return rare.join(short, "shingle").where("component <> lead_component and n >= lead_n").where(close).select(F.greatest("id", "lead").alias("id"), F.least("id", "lead").alias("lead")).distinct()


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges that can reach a smaller one, and the smallest that each can reach."""
    ids, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    low = root != np.arange(len(ids))
    return ids[low], ids[root[low]]


def _forests(batches, most: int):
    held, size = [], 0

    def joined():
        u, v = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(u, v)], names=["u", "v"])

    for batch in batches:
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
        size += batch.num_rows
        if size >= most:
            yield joined()
            held, size = [], 0
    if size:
        yield joined()


def components(edges: DataFrame, folder: str, most: int = FOREST_EDGES) -> DataFrame:
    """(id, component): each node that reaches a smaller one, with the smallest that it can reach. edges: a stored table, may repeat rows.

    Up to `most` edges are joined in one task. More are joined in parts of so many, and then by
    alternating large and small stars. Each round's edges are written to the shared folder; a hot
    node's minimum is a partial aggregate, never a list.
    """
    small_batches(edges.sparkSession)
    few = edges.count() <= most
    now = (edges.repartition(1) if few else edges).toDF("u", "v").where("u <> v")
    now, seen = stored(now.mapInArrow(partial(_forests, most=most), "u long, v long"), f"{folder}/forests"), None
    if few:
        return now.toDF("id", "component")
    for k in counted():
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        now = stored(small, f"{folder}/round{k}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of documents (doc_id, text).

    1. Rows with equal shingle sets are one class; the smallest doc_id stands for it.
    2. Representatives meet in the buckets of 32 bands of 4 coordinates (a pair at similarity 0.75
       is missed with probability 5e-6). In each bucket all are checked against two members, those that
       meet most others and fewest, so a group of copies costs twice as many checks as it has members.
       Pairs whose coordinates agree far too little are no links; of the others full sets are compared.
    3. Documents of buckets of four members or more that still hold several components are searched for
       links between components by their rarest shingles (see across), which is exact. Mates in one
       component need no check, as a link between them can't change the result.

    Null or blank texts have no shingles and no links. Rows that repeat a doc_id are one node of
    the graph, each returned. A null doc_id is linked with nothing, has a null component, and is kept.
    Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    folder = shared_folder(spark, "near-dups")
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = stored(described(documents), f"{folder}/described")
    linked = rows.where("n_shingles > 0 and doc_id is not null")
    classes = stored(linked.groupBy("key_a", "key_b").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("r")).select("key_a", "key_b", "r.*"), f"{folder}/classes")

    places = classes.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    places = stored(places.join(shared, "bucket"), f"{folder}/shared")
    degree = places.groupBy("id").agg(F.sum("members").alias("degree"))
    places = stored(places.join(degree, "id").select("bucket", "id", "members", "degree"), f"{folder}/places")
    rank = F.struct("degree", (-F.col("id")).alias("minus"))
    lead = places.groupBy("bucket").agg(F.max(rank).alias("most"), F.min(rank).alias("fewest"))
    lead = lead.select("bucket", F.explode(F.array(-F.col("most.minus"), -F.col("fewest.minus"))).alias("lead"))
    stars = places.join(lead, "bucket").where("id <> lead").select(F.greatest("id", "lead").alias("id"), F.least("id", "lead").alias("lead"))
    stars = promising(stored(stars.distinct(), f"{folder}/stars"), classes, f"{folder}/stars")
    first = verified(stars, texts, f"{folder}/stars")
    found = components(first, f"{folder}/first-components")

    placed = places.where("members > 3").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    apart = stored(placed.join(mixed, "bucket", "left_semi").select("id", "component").distinct(), f"{folder}/apart")
    rest = stored(across(apart, texts, f"{folder}/across").join(stars, ["id", "lead"], "left_anti"), f"{folder}/rest")
    if rest.take(1):
        second = verified(promising(rest, classes, f"{folder}/rest"), texts, f"{folder}/rest")
        found = components(found.union(second), f"{folder}/components") if second.take(1) else found

    named = classes.select("key_a", "key_b", F.col("doc_id").alias("id")).join(found, "id", "left").select("key_a", "key_b", F.coalesce("component", "id").alias("own"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key_a")).alias("key_a"), F.when(F.col("n_shingles") > 0, F.col("key_b")).alias("key_b")).join(named, ["key_a", "key_b"], "left")
    repeated = out.groupBy("doc_id").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x < y")
    if repeated.take(1):  # ids with rows in several components: those are one
        joint = components(stored(repeated.select("x", "y").union(out.join(repeated, "doc_id").select("own", "x")), f"{folder}/repeated"), f"{folder}/joint")
        out = out.join(joint, out.own == joint.id, "left").withColumn("own", F.coalesce("component", "own"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("own", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
