"""Sinks: group, history and pattern reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_groups(found: DataFrame, path: str) -> None:
    """group_id, count, score (two decimals) and display, as one CSV file of the ranked groups."""
    rows = found.select("group_id", "count", F.format_string("%.2f", "score").alias("score"), F.col("display").alias("text"))
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_last_messages(found: DataFrame, path: str) -> None:
    """group_id, last time, count, score (three decimals) and the last raw line."""
    rows = found.select("group_id", F.from_unixtime("updated").alias("last_update"), "count", F.format_string("%.3f", "score").alias("score"), F.col("last_message").alias("text"))
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_history(cells: DataFrame, path: str, unit: int) -> dict:
    """itemid, clock and value as CSV, and their span as <path without .csv>_info.json beside them and as the result."""
    rows = cells.select(F.col("group_id").alias("itemid"), "clock", "value")
    rows.write.mode("overwrite").option("header", True).csv(path)
    span = cells.agg(F.min("clock").alias("start"), F.max("clock").alias("end")).first()
    info = {"start": span["start"], "end": span["end"], "unit_secs": unit}
    _write_text(cells.sparkSession, f"{path.removesuffix('.csv')}_info.json", json.dumps(info))
    return info


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, wherever Spark writes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def group_report(found: DataFrame) -> list[str]:
    """Lines of a bounded table of groups (after top())."""
    return [f"{r['count']:>10} {r['score']:8.2f} {r['display']}" for r in found.collect()]


def bounded(rows: DataFrame, most: int) -> tuple[list, list[str]]:
    """The first rows, and a line that says so if there are more."""
    found = rows.limit(most + 1).collect()
    return found[:most], [f"... only the first {most} rows are shown; -o DIR writes all"] if len(found) > most else []


def pattern_report(patterns: DataFrame, displays: DataFrame | None = None, most: int = 100) -> list[str]:
    """Lines for the screen of the most frequent patterns (after ranked()): the sequence, its total, its keys, and the groups' texts.

    The first `most` rows only, which the last line says then; write_patterns() writes all.
    """
    (rows, more), out, last = bounded(patterns, most), [], None
    texts = {}
    if displays is not None:
        wanted = sorted({int(g) for r in rows for g in r["pattern"].split()})
        texts = {r["group_id"]: r["display"] for r in displays.where(F.col("group_id").isin(wanted)).collect()} if wanted else {}
    for k, r in enumerate(rows):
        if r["pattern"] != last:
            out += [r["pattern"], f"=> total {r['total']}"]
        out.append(f"{r['key']}: {{startEpoch: {r['start_epoch']}, count: {r['cnt']}}}")
        last = r["pattern"]
        if texts and (k + 1 == len(rows) or rows[k + 1]["pattern"] != last):
            out += ["---", *(texts.get(int(g), "") for g in last.split())]
    return out + more


def write_patterns(patterns: DataFrame, displays: DataFrame, path: str) -> None:
    """All patterns of ranked() with all keys, as CSV: total, pattern, key, start_epoch, cnt; and the groups' texts beside them."""
    rows = patterns.select("total", "pattern", "key", "start_epoch", "cnt").orderBy(F.desc("total"), "pattern", F.desc("cnt"), "key")
    rows.write.mode("overwrite").option("header", True).csv(path)
    used = patterns.select(F.explode(F.split("pattern", " ").cast("array<long>")).alias("group_id")).distinct()
    texts = used.join(displays.select("group_id", "display"), "group_id", "left")
    texts.write.mode("overwrite").option("header", True).csv(f"{path.removesuffix('.csv')}_groups.csv")


def write_lines(rows: DataFrame, path: str) -> None:
    """A column of strings as text."""
    rows.select(F.col(rows.columns[0]).cast("string")).write.mode("overwrite").text(path)
