"""Sources: log files in order of their times, tables of text, and JSON metrics."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def log_lines(spark: SparkSession, path: str, since: tuple[int, int] | None = None) -> DataFrame:
    """source, file_epoch, ord and line of text files (plain or .gz) that match a path; FileNotFoundError if none does.

    ord is a struct that sorts lines by file time, path and place, so no window orders all lines.
    since: (epoch, rows): only files from that time on (after it, if rows is -1), without the first
    `rows` lines of a file of just that time. An empty path reads standard input.
    """
    if path == "":
        return standard_input(spark)
    try:
        raw = spark.read.text(path)
    except AnalysisException as missing:
        raise FileNotFoundError(path) from missing
    rows = raw.select(
        F.col("_metadata.file_path").alias("source"),
        F.unix_timestamp("_metadata.file_modification_time").alias("file_epoch"),
        F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).alias("ord"),
        F.col("value").alias("line"),
    )
    if since is None:
        return rows
    epoch, skipped = since
    if skipped < 0:
        return rows.where(F.col("file_epoch") > epoch)
    rows = rows.where(F.col("file_epoch") >= epoch)
    if not skipped:
        return rows
    first = rows.where(F.col("file_epoch") == epoch)
    oldest = first.agg(F.min("source").alias("source"))
    done = first.join(F.broadcast(oldest), "source", "left_semi").orderBy("ord").limit(skipped)
    return rows.join(done.select("ord"), "ord", "left_anti").select(*rows.columns)


def numbered(lines: DataFrame) -> DataFrame:
    """log_lines() with nr, a line's number in its file from 0: its place in its block and the lines of the blocks before."""
    blocks = lines.groupBy("source", F.col("ord.block").alias("block")).agg(F.count("*").alias("n"), F.min("ord.place").alias("least"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    shift = blocks.select("source", "block", (F.coalesce(before, F.lit(0)) - F.col("least")).alias("_shift"))
    rows = lines.withColumn("block", F.col("ord.block")).join(F.broadcast(shift), ["source", "block"])  # a row for a block of a file
    return rows.withColumn("nr", F.col("ord.place") + F.col("_shift")).select(*lines.columns, "nr")


def contents(rows: DataFrame) -> DataFrame:
    """(source, rows, first, digest) of each file of numbered lines.

    first is a hash of the first line, digest of the others but the last, which may have been half written.
    """
    sizes = rows.groupBy("source").agg(F.count("*").alias("rows"), F.max(F.when(F.col("nr") == 0, F.xxhash64("line"))).alias("first"))
    inner = rows.join(F.broadcast(sizes.select("source", "rows")), "source").where("nr > 0 and nr < rows - 1")  # a row for a file
    digests = inner.groupBy("source").agg(F.bit_xor(F.xxhash64("line", "nr")).alias("digest"))
    return sizes.join(digests, "source", "left").select("source", "rows", "first", F.coalesce("digest", F.lit(0)).alias("digest"))


def read_before(rows: DataFrame, known: list[tuple[str, int, int, int]]) -> DataFrame:
    """Numbered lines without those that files of contents() had: a file goes on from a known one that it begins with.

    A known file that is still under its own name is not looked for under others.
    """
    if not known:
        return rows.drop("nr")
    spark = rows.sparkSession
    old = spark.createDataFrame(known, "old string, had long, first long, digest long")
    sizes = rows.groupBy("source").agg(F.count("*").alias("rows"), F.max(F.when(F.col("nr") == 0, F.xxhash64("line"))).alias("first"))
    tried = sizes.join(F.broadcast(old), "first").where("rows >= had").select("source", "old", "had", "digest")
    inner = rows.join(F.broadcast(tried.select("source", "old", "had")), "source").where("nr > 0 and nr < had - 1")  # few known files have the same first line
    digests = inner.groupBy("source", "old").agg(F.bit_xor(F.xxhash64("line", "nr")).alias("found"))
    same = tried.join(digests, ["source", "old"], "left").where(F.coalesce("found", F.lit(0)) == F.col("digest")).collect()
    own = {r["source"]: r["had"] for r in same if r["source"] == r["old"]}
    skipped = dict(own)
    for r in same:
        if r["source"] not in own and r["old"] not in own:
            skipped[r["source"]] = max(skipped.get(r["source"], 0), r["had"])
    done = spark.createDataFrame(list(skipped.items()), "source string, had long")
    return rows.join(F.broadcast(done), "source", "left").where(F.col("nr") >= F.coalesce("had", F.lit(0))).drop("had", "nr")


def standard_input(spark: SparkSession, stream=None) -> DataFrame:
    """The lines of standard input, which the driver holds."""
    lines = [(k, line.rstrip("\n")) for k, line in enumerate(stream or sys.stdin)]
    rows = spark.createDataFrame(lines, "place long, line string")
    return rows.select(F.lit("").alias("source"), F.lit(0).cast("long").alias("file_epoch"), F.struct(F.lit(None).cast("timestamp").alias("time"), F.lit("").alias("path"), F.lit(0).cast("long").alias("block"), "place").alias("ord"), "line")


def line_counts(lines: DataFrame) -> DataFrame:
    """(source, lines) of each file."""
    return lines.groupBy("source").agg(F.count("*").alias("lines"))


def separated(spark: SparkSession, path: str, separator: str = ",", header: bool = False, schema: str | None = None) -> DataFrame:
    """Separated values, plain or .gz."""
    reader = spark.read.option("sep", separator).option("header", header)
    return (reader.schema(schema) if schema else reader).csv(path)


def document_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, ln, line) of the lines of documents that aren't blank; ln counts all lines from 0."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return lines.where(F.trim("line") != "")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row a time with a column for each metric (the largest of several values), from JSON [{metric, datapoints: [[value, time]]}]."""
    raw = spark.read.option("multiLine", True).schema("metric string, datapoints array<array<double>>").json(path)
    points = raw.select("metric", F.explode("datapoints").alias("p")).select("metric", F.col("p")[1].cast("long").alias("time"), F.col("p")[0].alias("value"))
    return points.groupBy("time").pivot("metric").agg(F.max("value"))
