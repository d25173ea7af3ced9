"""Lines to messages: filters, timestamp and message extraction, message formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions.dialects import group_names, java_regex
from siltstone.functions.scalars import parse_date, time_bucket


def matches(text: Column, search=(), exclude=()) -> Column:
    """True if every search pattern is found and no exclude pattern is."""
    found = [text.rlike(java_regex(p)) for p in search] + [~text.rlike(java_regex(p)) for p in exclude]
    return reduce(lambda a, b: a & b, found, F.lit(True))


def normalised(line: Column) -> Column:
    """Runs of white space as one space, without any at the ends."""
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def message_format(msg: Column, formats) -> Column:
    """Each matching format in turn replaces the message by its `message` group."""
    for pattern in formats:
        names = group_names(pattern)
        if "message" not in names:
            raise ValueError(f"a message format without a message group: {pattern}")
        msg = F.when(msg.rlike(java_regex(pattern)), F.regexp_extract(msg, java_regex(pattern), names["message"])).otherwise(msg)
    return msg


def parsed(lines: DataFrame, config: Config, now: Column | None = None) -> DataFrame:
    """lines (with a column line, and file_epoch if known) with text, msg, epoch and bucket.

    Filters apply to the raw line. Without timestamp and message groups the whole line is the
    message, at the file's time, bucket -1. A line that the log format doesn't match is an empty
    message at 0. A timestamp that can't be parsed leaves the whole line, at the file's time, bucket 0.
    text is the message before message formats; session keys are looked for in it.
    """
    rows = lines.where(matches(F.col("line"), config.search_regex, config.exclude_regex))
    line = normalised(F.col("line"))
    file_epoch = F.col("file_epoch") if "file_epoch" in lines.columns else F.lit(0).cast("long")
    names = group_names(config.log_format) if config.log_format else {}
    zero = F.lit(0).cast("long")
    if not {"timestamp", "message"} & set(names):
        text, epoch, bucket = line, file_epoch, F.lit(-1).cast("long")
    else:
        pattern = java_regex(config.log_format)
        hit = line.rlike(pattern) if "timestamp" in names else F.lit(True)
        stamp = F.regexp_extract(line, pattern, names["timestamp"]) if "timestamp" in names else F.lit(None)
        when = parse_date(stamp, config.timestamp_layout, now) if config.timestamp_layout and "timestamp" in names else F.lit(None).cast("long")
        message = F.regexp_extract(line, pattern, names["message"]) if "message" in names else line
        rows = rows.withColumns({"_hit": hit, "_when": when})
        good = F.col("_when") > 0
        text = F.when(~F.col("_hit"), "").when(good, message).otherwise(line)
        epoch = F.when(~F.col("_hit"), zero).otherwise(F.when(good, F.col("_when")).otherwise(file_epoch))
        bucket = F.when(F.col("_hit") & good, time_bucket(F.col("_when"), config.unit_secs)).otherwise(zero)
    empty = line == ""
    out = rows.withColumns({"text": F.when(empty, "").otherwise(text), "epoch": F.when(empty, zero).otherwise(epoch), "bucket": F.when(empty, zero).otherwise(bucket)})
    return out.withColumn("msg", message_format(F.col("text"), config.msg_formats)).drop("_hit", "_when")
