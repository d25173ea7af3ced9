"""Counts per group and time bucket, dense timelines, anomalies and periodicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import time_bucket


def counted(rows: DataFrame, unit: int, *by: str) -> DataFrame:
    """(by..., clock, value): rows of each group (a column or several) per bucket of `unit` seconds of the column epoch."""
    return rows.where("epoch > 0").groupBy(*by, time_bucket(F.col("epoch"), unit).alias("clock")).agg(F.count("*").alias("value"))


def group_history(messages: DataFrame, masked: DataFrame, unit: int) -> DataFrame:
    """(group_id, clock, value) from messages (tokens, epoch) and the masks of their sequences."""
    cells = counted(messages, unit, "tokens")
    return cells.join(masked.select("tokens", F.xxhash64("masked").alias("group_id")), "tokens").groupBy("group_id", "clock").agg(F.sum("value").cast("long").alias("value"))


def dense(cells: DataFrame, unit: int, by: str) -> DataFrame:
    """Every bucket from the first to the last for every group, 0 where it has no rows."""
    span = cells.agg(F.min("clock").alias("low"), F.max("clock").alias("high"))
    line = cells.select(by).distinct().crossJoin(F.broadcast(span)).where("low is not null")
    line = line.select(by, F.explode(F.sequence("low", "high", F.lit(unit).cast("long"))).alias("clock"))
    return line.join(cells, [by, "clock"], "left").select(by, "clock", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def largest(cells: DataFrame, by: str, n: int) -> DataFrame:
    """The cells of the n groups with the largest totals (ties: the smaller group)."""
    totals = cells.groupBy(by).agg(F.sum("value").alias("total")).orderBy(F.desc("total"), by).limit(n)
    return cells.join(F.broadcast(totals.select(by)), by, "left_semi")  # n rows


def cell(cells: DataFrame, by: str, asked: DataFrame) -> DataFrame:
    """asked (by, clock) with value, -1 where there is no such cell."""
    return asked.join(cells, [by, "clock"], "left").withColumn("value", F.coalesce("value", F.lit(-1).cast("long")))


def repeats(signs: Column) -> Column:
    """Is there a period from 2 to half the length after which an array's values repeat?"""
    size = F.size(signs)

    def holds(p: Column) -> Column:
        head, tail = F.slice(signs, 1, size - p), F.slice(signs, p + 1, size)
        return F.forall(F.zip_with(head, tail, lambda a, b: a == b), lambda same: F.coalesce(same, F.lit(False)))

    half = F.floor(size / 2).cast("int")
    return F.when(half < 2, False).otherwise(F.exists(F.sequence(F.lit(2), F.greatest(half, F.lit(2))), holds))


def periodic(series: DataFrame, by: str, deviations: float) -> DataFrame:
    """(by, periodic) from a dense series: whether the signs of threshold crossings repeat. No crossing counts as periodic."""
    # mean and deviation as Spark's aggregates, so that they equal those of anomalies()
    w = Window.partitionBy(by)
    mean, deviation = F.avg("value").over(w), F.stddev_pop("value").over(w)
    sign = F.when(F.col("value") > mean + deviation * deviations, 1).when(F.col("value") < mean - deviation * deviations, -1).otherwise(0)
    signs = series.withColumn("sign", sign).groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("clock", "sign"))), lambda s: s["sign"]).alias("signs"))
    return signs.select(by, repeats(F.col("signs")).alias("periodic"))


def anomalies(series: DataFrame, by: str, deviations: float = 2.0, least: float = 10.0, since: int = 0) -> DataFrame:
    """(by, clock, value, kind): disappearances and spikes in dense series that aren't periodic.

    kind is 'disappearance' if the bucket before has at least `least` and this one is below mean - k
    population deviations, 'spike' if it is above mean + k. The first bucket is never an anomaly.
    """
    w = Window.partitionBy(by)
    rows = series.withColumns({"mean": F.avg("value").over(w), "deviation": F.stddev_pop("value").over(w), "before": F.lag("value").over(w.orderBy("clock"))})
    low, high = F.col("mean") - F.col("deviation") * deviations, F.col("mean") + F.col("deviation") * deviations
    kind = F.when((F.col("before") >= least) & (F.col("value") < low), "disappearance").when(F.col("value") > high, "spike")
    found = rows.withColumn("kind", kind).where(F.col("kind").isNotNull() & F.col("before").isNotNull() & (F.col("clock") >= since))
    return found.join(periodic(series, by, deviations).where(~F.col("periodic")), by).select(by, "clock", "value", "kind")
