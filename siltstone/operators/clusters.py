"""Clusters of vectors: distances, centroids, k-means and how compact clusters are.

Vectors are array columns. Centroids are few (a row for a cluster) and are broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.workspace import stored


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda t, v: t + v))


def centroids(vectors: DataFrame) -> DataFrame:
    """(cluster, centroid) from (cluster, vector): the mean of each coordinate."""
    each = vectors.select("cluster", F.posexplode("vector").alias("k", "v")).groupBy("cluster", "k").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return each.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("centroid"))


def assigned(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """vectors (id, vector) with the nearest of the centroids, the smaller cluster among equals, and its distance.

    Each row looks through one broadcast array of all centroids; no pairs are made.
    """
    all_ = centres.agg(F.sort_array(F.collect_list(F.struct("cluster", "centroid"))).alias("centres"))
    near = F.array_min(F.transform("centres", lambda c: F.struct(distance(F.col("vector"), c["centroid"]).alias("d"), c["cluster"].alias("cluster"))))
    rows = vectors.crossJoin(F.broadcast(all_)).withColumn("near", near)  # one row of centroids
    return rows.select("id", "vector", F.col("near.cluster").alias("cluster"), F.col("near.d").alias("distance"))


def kmeans(vectors: DataFrame, k: int, seed: int = 1, rounds: int = 20) -> DataFrame:
    """id, vector and cluster by Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("id", "vector", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds).fit(rows)
    return model.transform(rows).select("id", "vector", F.col("prediction").alias("cluster"))


def lloyd(vectors: DataFrame, first: DataFrame, rounds: int) -> DataFrame:
    """id, vector, cluster and distance after some rounds of k-means from given first centres (cluster, centroid)."""
    centres = first
    for _ in range(rounds):
        centres = stored(centroids(assigned(vectors, centres).select("cluster", "vector")), "centres")
    return assigned(vectors, centres)


def spreads(vectors: DataFrame) -> DataFrame:
    """(cluster, size, intra): the mean distance of a cluster's members to its centroid, over n - 1."""
    rows = vectors.join(F.broadcast(centroids(vectors)), "cluster")
    return rows.groupBy("cluster").agg(F.count("*").alias("size"), (F.sum(distance(F.col("vector"), F.col("centroid"))) / F.greatest(F.count("*") - 1, F.lit(1))).alias("intra"))


def separations(vectors: DataFrame) -> DataFrame:
    """(a, b, inter): distances between the centroids of clusters, a < b."""
    c = centroids(vectors)
    other = c.toDF("b", "other")
    return c.withColumnRenamed("cluster", "a").join(F.broadcast(other), F.col("a") < F.col("b")).select("a", "b", distance(F.col("centroid"), F.col("other")).alias("inter"))


def compactness(vectors: DataFrame, n: int) -> DataFrame:
    """One row: the mean spread of the n largest clusters (ties: the smaller cluster)."""
    return spreads(vectors).orderBy(F.desc("size"), "cluster").limit(n).agg(F.avg("intra").alias("compactness"))


def best_kmeans(vectors: DataFrame, k: int, trials: int, n: int) -> DataFrame:
    """The k-means result, of several seeds, whose n largest clusters are most compact."""
    scored = [(compactness(kmeans(vectors, k, seed), n).first()["compactness"], seed) for seed in range(1, trials + 1)]
    return kmeans(vectors, k, min(scored)[1])


def silhouettes(vectors: DataFrame) -> DataFrame:
    """(id, cluster, silhouette) by distances to centroids: nearest other against own."""
    c = centroids(vectors).agg(F.collect_list(F.struct("cluster", "centroid")).alias("centres"))
    rows = vectors.crossJoin(F.broadcast(c))  # one row of centroids
    own = F.filter("centres", lambda x: x["cluster"] == F.col("cluster"))[0]["centroid"]
    others = F.array_min(F.transform(F.filter("centres", lambda x: x["cluster"] != F.col("cluster")), lambda x: distance(F.col("vector"), x["centroid"])))
    a, b = distance(F.col("vector"), own), others
    return rows.select("id", "cluster", F.when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(0.0).alias("silhouette"))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(block, ids, clusters, there, whole) of vectors (id, cluster, vector): at most `size` rows each, sorted by cluster.

    there: the numbers of all vectors, one after the other (4 bytes each if they are floats, else 8);
    whole: a byte for a row, 0 where its vector is null. Null elements and other lengths are refused.
    """
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    single = kinds["vector"] == "array<float>"

    def pack(batches):  # whole within itself: executors need not have this module
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        def block(rows, k):
            ids, clusters, vector = (pa.concat_arrays(rows[c].chunks) for c in ("id", "cluster", "vector"))
            whole = vector.is_valid().to_numpy(zero_copy_only=False)
            numbers, known = vector.flatten(), int(whole.sum())
            width = len(numbers) // max(known, 1)
            if numbers.null_count or np.any(vector.value_lengths().drop_null().to_numpy() != width):
                raise ValueError("vectors of other lengths, or with null elements, have no distance")
            there = np.zeros((len(whole), width), "f4" if single else "f8")
            there[whole] = numbers.to_numpy().reshape(known, width)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), x) for x in (ids, clusters)]
            columns = [pa.array([TaskContext.get().partitionId() << 32 | k], pa.int64()), *lists, pa.array([there.tobytes()]), pa.array([whole.tobytes()])]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "clusters", "there", "whole"])

        held, k = None, 0
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, more]) if held else more
            while len(held) >= size:
                yield block(held.slice(0, size), k)
                held, k = held.slice(size), k + 1
        if held:
            yield block(held, k)

    rows = vectors.select("id", "cluster", F.col("vector").cast("array<float>" if single else "array<double>").alias("vector"))
    ranges = rows.repartitionByRange(rows.count() // (8 * size) + 1, "cluster", F.xxhash64("id")).sortWithinPartitions("cluster")
    return ranges.mapInArrow(pack, f"block long, ids array<{kinds['id']}>, clusters array<{kinds['cluster']}>, there binary, whole binary")


def block_sums(pairs: DataFrame, single: bool) -> DataFrame:
    """(id, cluster, to, far, n) from pairs of blocks(), the columns of the second named other_...

    n counts the members of cluster `to` in the other block that have another id and a vector (if the row has
    one), far is the sum of the distances to them; both ways for two blocks, once for a block with itself. Squares come from
    one matrix product of coordinates around the block's mean; the differences of the coordinates are
    taken where it would lose digits (near and infinite pairs).
    """
    kinds = {f.name: f.dataType.elementType.simpleString() for f in pairs.select("ids", "clusters").schema}

    def meet(batches):  # whole within itself, as above
        import numpy as np
        import pyarrow as pa

        def read(row, prefix):
            ids, clusters = row[prefix + "ids"][0].values, row[prefix + "clusters"][0].values
            whole = np.frombuffer(row[prefix + "whole"][0].as_py(), bool)
            there = np.frombuffer(row[prefix + "there"][0].as_py(), "f4" if single else "f8").reshape(len(whole), -1) if whole.any() else None
            codes = clusters.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            return ids, clusters, whole, None if there is None else there.astype("f8"), starts

        def distances(a, b):
            """The distances of 256 rows at a time."""
            if a.shape[1] != b.shape[1]:
                raise ValueError("vectors of other lengths have no distance")
            x, y = a - a.mean(axis=0), b - a.mean(axis=0)
            xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
            left = np.c_[-2 * x, xx, np.ones(len(x))]
            right = np.ascontiguousarray(np.c_[y, np.ones(len(y)), yy].T)
            for lo in range(0, len(x), 256):
                d = left[lo : lo + 256] @ right
                if not d.min() > 1e-6 * (xx[lo : lo + 256].max() + yy.max()):
                    r, c = np.nonzero(~(d > 1e-6 * np.add.outer(xx[lo : lo + 256], yy)))
                    for k in range(0, len(r), 1 << 16):
                        far = a[lo + r[k : k + (1 << 16)]] - b[c[k : k + (1 << 16)]]
                        d[r[k : k + (1 << 16)], c[k : k + (1 << 16)]] = np.einsum("ij,ij->i", far, far)
                yield lo, np.sqrt(d, out=d)

        def same_ids(one, two):
            """The places (in one, in two) of rows with equal ids."""
            one, two = (x.to_numpy(zero_copy_only=False) for x in (one, two))
            order = np.argsort(two, kind="stable")
            first, last = (np.searchsorted(two[order], one, side) for side in ("left", "right"))
            times = last - first
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            return np.repeat(np.arange(len(one)), times), order[np.repeat(first, times) + within]

        def result(side, other, far, n, met):
            """Rows (of side) by clusters (of other); only those that meet another id."""
            r, k = np.nonzero(met)
            at = pa.array(r)
            return pa.RecordBatch.from_arrays([side[0].take(at), side[1].take(at), other[1].take(pa.array(other[4][k])), pa.array(far[r, k]), pa.array(n[r, k])], ["id", "cluster", "to", "far", "n"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                one, two = read(row, ""), read(row, "other_")
                r, c = same_ids(one[0], two[0])
                seg1, seg2 = (np.searchsorted(x[4], np.arange(len(x[2])), "right") - 1 for x in (one, two))
                far1, far2 = np.zeros((len(one[2]), len(two[4]))), np.zeros((len(two[2]), len(one[4])))
                met1, met2 = (np.repeat(np.diff(np.r_[y[4], len(y[2])])[None], len(x[2]), axis=0).astype("i8") for x, y in ((one, two), (two, one)))
                n1, n2 = (np.where(x[2][:, None], np.add.reduceat(y[2].astype("i8"), y[4])[None], 0) for x, y in ((one, two), (two, one)))
                both = (one[2][r] & two[2][c]).astype("i8")
                for of, places, segments, less in ((met1, r, seg2[c], 1), (met2, c, seg1[r], 1), (n1, r, seg2[c], both), (n2, c, seg1[r], both)):
                    np.subtract.at(of, (places, segments), less)
                twice = row["block"][0].as_py() != row["other_block"][0].as_py()
                if one[3] is not None and two[3] is not None:
                    with np.errstate(all="ignore"):
                        for lo, d in distances(one[3], two[3]):
                            inside = (r >= lo) & (r < lo + len(d))
                            d[r[inside] - lo, c[inside]] = 0
                            d[~one[2][lo : lo + len(d)]] = 0
                            d[:, ~two[2]] = 0
                            far1[lo : lo + len(d)] = np.add.reduceat(d, two[4], axis=1)
                            if twice:
                                s = seg1[lo : lo + len(d)]
                                far2[:, s[0] : s[-1] + 1] += np.add.reduceat(d, np.flatnonzero(np.r_[True, s[1:] != s[:-1]]), axis=0).T
                yield result(one, two, far1, n1, met1)
                if twice:
                    yield result(two, one, far2, n2, met2)

    return pairs.mapInArrow(meet, f"id {kinds['ids']}, cluster {kinds['clusters']}, to {kinds['clusters']}, far double, n long")


def pair_silhouettes(vectors: DataFrame, tile: int = 2048) -> DataFrame:
    """(id, cluster, silhouette) by mean distances to all members of clusters; a lone member has 0.

    The score's definition compares every vector with every other, so time grows with the square of the
    rows: silhouettes() is the measure for large tables. Rows meet in pairs of blocks of at most `tile`
    rows, each pair once for both sides; blocks are read by grids of partitions, not copied for each pair.
    Rows without an id are not scored, rows without a cluster or vector have 0 and are no members; where
    all distances are 0 the score is NaN.
    """
    spark = vectors.sparkSession
    at_once = 16 << 20  # a pair of blocks is some MB; read as the lazy result runs, so it stays in the session
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not now.isdigit() or not 0 < int(now) <= at_once:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(at_once))
    known = vectors.where(F.col("id").isNotNull())
    cut = stored(blocks(known, tile), "blocks")
    n, size = cut.agg(F.count("*"), F.coalesce(F.sum(F.length("there")), F.lit(0))).first()
    side = min(max(math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism)), math.ceil(size / (64 << 20))), max(n, 1))
    one = cut.repartition(side)
    two = cut.select(*(F.col(c).alias("other_" + c) for c in cut.columns)).repartition(side)
    pairs = one.join(two.hint("shuffle_replicate_nl"), F.col("block") <= F.col("other_block"))
    sums = block_sums(pairs, vectors.schema["vector"].dataType.simpleString() == "array<float>")
    means = sums.groupBy("id", "cluster", "to").agg(F.when(F.sum("n") > 0, F.sum("far") / F.sum("n")).alias("d"))
    rows = means.groupBy("id", "cluster").agg(F.max(F.when(F.col("to") == F.col("cluster"), F.col("d"))).alias("a"), F.min(F.when(F.col("to") != F.col("cluster"), F.col("d"))).alias("b"))
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).when(F.greatest("a", "b") == 0, float("nan")).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return rows.select("id", "cluster", score.alias("silhouette"))


def without_outliers(vectors: DataFrame, deviations: float) -> DataFrame:
    """Members whose distance to the centroid is within k population deviations of the cluster's mean distance."""
    w = Window.partitionBy("cluster")
    rows = vectors.join(F.broadcast(centroids(vectors)), "cluster").withColumn("distance", distance(F.col("vector"), F.col("centroid")))
    rows = rows.withColumns({"mean": F.avg("distance").over(w), "std": F.stddev_pop("distance").over(w)})
    return rows.where(F.abs(F.col("distance") - F.col("mean")) <= F.col("std") * deviations).select("id", "cluster", "vector", "distance")
