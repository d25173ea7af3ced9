"""Incremental feeds: batches of lines merged into the store, as calls or as a stream."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.config import Config
from siltstone.functions.workspace import stored
from siltstone.operators import patterns
from siltstone.operators.parsing import parsed
from siltstone.operators.templates import groups, masked_sequences, with_df
from siltstone.operators.terms import idf, term_counts
from siltstone.operators.tokens import MASK, tokens
from siltstone.sources.readers import contents, log_lines, numbered, read_before
from siltstone.sources.store import PLACE, TABLES, Store, block_of

GROUPS = "block long, masked array<string>, group_id long, display string, count long, created long, updated long, last_message string"
TERMS = "block long, feed long, term string, df long"
STATUS = "feed long, source string, rows long, first long, digest long"


def store_of(spark: SparkSession, config: Config) -> Store:
    by_feed = {"groups": GROUPS, "pattern_keys": TABLES["pattern_keys"], "pattern_tags": TABLES["pattern_tags"]}
    return Store(spark, config.data_dir, {"terms": TERMS, "status": STATUS, **{k: v.replace("block long", "block long, feed long", 1) for k, v in by_feed.items()}})


def _place(messages: DataFrame) -> Column:
    """ord as the store has it: that of log files, or the number of a line in a batch."""
    if isinstance(messages.schema["ord"].dataType, StructType):
        return F.col("ord").cast(PLACE)
    return F.struct(F.lit(None).cast("timestamp").alias("time"), F.lit("").alias("path"), F.lit(0).cast("long").alias("block"), F.col("ord").cast("long").alias("place"))


def feed(lines: DataFrame, config: Config, number: int) -> None:
    """Merge a batch of lines (line, ord, file_epoch) into the store.

    The batch's document frequencies are added to the store's, and its lines are masked by the sum: groups
    of earlier feeds keep the mask that they had. Rows are written with the feed's number, so a batch
    that is given again replaces itself. A group has a row for each block of its lines; blocks past
    keep_period and max_blocks are dropped then. With pattern_key_regexes, the lines of sessions and the
    keys' tags are stored too; keys of earlier feeds have been seen before this one's lines.
    """
    spark = lines.sparkSession
    store = store_of(spark, config)
    messages = parsed(lines, config).withColumn("tokens", tokens(F.col("msg"), config)).withColumn("block", block_of(F.greatest(F.col("bucket"), F.lit(0)), config.unit_secs))
    messages = stored(messages, "messages")  # raw logs are read and matched once
    fresh = term_counts(messages.groupBy("block", "tokens").agg(F.count("*").alias("lines")), "block").withColumn("feed", F.lit(number).cast("long"))
    earlier = store.read("terms").where(F.col("feed") != number)
    total = earlier.select("term", "df").union(fresh.select("term", "df")).groupBy("term").agg(F.sum("df").cast("long").alias("df"))
    found = groups(messages.drop("tokens"), config, counts=total).select("masked", "group_id", "display", "last_message")
    masks = stored(masked_sequences(messages.drop("tokens"), config, counts=total).select("tokens", "masked"), "masks")
    cells = messages.groupBy("block", "tokens").agg(F.count("*").alias("lines"), F.min("epoch").alias("created"), F.max("epoch").alias("updated")).join(masks, "tokens")
    cells = cells.groupBy("block", "masked").agg(F.sum("lines").cast("long").alias("count"), F.min("created").alias("created"), F.max("updated").alias("updated"))
    for table, rows in (("groups", cells.join(found, "masked")), ("terms", fresh), *_sessions(store, messages, masks, config, number).items()):
        _write(store, table, rows.withColumn("feed", F.lit(number).cast("long")))
    retain(spark, config)


def _sessions(store: Store, messages: DataFrame, masks: DataFrame, config: Config, number: int) -> dict[str, DataFrame]:
    """The lines of sessions and the latest tags of keys in each block; none without pattern_key_regexes."""
    if not config.pattern_key_regexes:
        return {}
    keyed = patterns.keys(messages.withColumn("ord", _place(messages)), config.pattern_key_regexes)
    earlier = store.read("pattern_keys").where((F.col("feed") < number) & F.col("matched")).select("pattern_key").distinct()
    records = patterns.associated(keyed.join(masks.select("tokens", F.xxhash64("masked").alias("group_id")), "tokens"), earlier)
    tags = keyed.where(F.col("pattern_key").isNotNull()).select("block", "pattern_key", "ord", F.explode("tags").alias("name", "value"))
    tags = tags.groupBy("block", "pattern_key", "name").agg(F.max_by("value", "ord").alias("value"), F.max("ord").alias("ord"))
    return {"pattern_keys": records, "pattern_tags": tags}


def _write(store: Store, table: str, rows: DataFrame) -> None:
    """Put rows in place of those of their feeds."""
    rows = rows.select(*[f.split()[0] for f in store.schemas[table].split(", ")])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feed").parquet(f"{store.path}/{table}")


def retain(spark: SparkSession, config: Config) -> None:
    """Drop blocks that are keep_period units or more before the last, and all but the last max_blocks; 0 keeps all.

    Block 0 holds the lines without a time: they have no age and stay.
    """
    store = store_of(spark, config)
    blocks = store.read("terms").select("block").union(store.read("groups").select("block")).where("block > 0").distinct()
    last = blocks.agg(F.max("block")).first()[0]
    if last is None:
        return
    low = last - config.keep_period + 1 if config.keep_period else 1
    if config.max_blocks:
        low = max(low, blocks.orderBy(F.desc("block")).limit(config.max_blocks).agg(F.min("block")).first()[0])
    old = (F.col("block") > 0) & (F.col("block") < low)
    for table in ("groups", "terms", "pattern_keys", "pattern_tags"):
        feeds_of = lambda rows: {r["feed"] for r in rows.select("feed").distinct().collect()}
        rows = store.read(table)
        touched = feeds_of(rows.where(old))
        left = rows.where(F.col("feed").isin(list(touched)) & ~old)
        empty = touched - feeds_of(left)
        if touched - empty:
            _write(store, table, left)
        for number in empty:
            store.drop(f"{table}/feed={number}")


def resume(spark: SparkSession, config: Config) -> int:
    """feed() of the lines of the settings' log files that no earlier call has read, under the next number, which it returns.

    Files are known by their contents, so a log that has grown, was renamed or is gone is neither read
    twice nor lost. The status is written last: a call that failed is made again under its number.
    Standard input has no position.
    """
    store = store_of(spark, config)
    status = store.read("status")
    last = status.agg(F.max("feed")).first()[0]
    number = 0 if last is None else last + 1
    known = {r["source"]: (r["source"], r["rows"], r["first"], r["digest"]) for r in status.where(F.col("feed") == number - 1).collect()}
    lines = log_lines(spark, config.log_path)
    if config.log_path:
        rows = numbered(lines)
        fresh = read_before(rows, [k for k in known.values() if k[0]])
        known |= {r["source"]: tuple(r) for r in contents(rows).collect()}
        lines = fresh
    known.setdefault("", ("", 0, 0, 0))  # a row for the number if there are no files
    feed(lines, config, number)
    found = spark.createDataFrame(list(known.values()), "source string, rows long, first long, digest long")
    _write(store, "status", found.withColumn("feed", F.lit(number).cast("long")))
    return number


def stored_groups(spark: SparkSession, config: Config) -> DataFrame:
    """The groups of all feeds: counts of equal masks added, the last message by time."""
    rows = store_of(spark, config).read("groups")
    return rows.groupBy("masked").agg(F.first("group_id").alias("group_id"), F.max_by("display", F.struct("updated", "feed")).alias("display"), F.sum("count").cast("long").alias("count"), F.min("created").alias("created"), F.max("updated").alias("updated"), F.max_by("last_message", F.struct("updated", "feed")).alias("last_message"))


def scored_groups(spark: SparkSession, config: Config) -> DataFrame:
    """stored_groups() with score, by the frequencies of all terms that the store holds now."""
    found, counts = stored_groups(spark, config), stored(stored_terms(spark, config), "terms")
    total = counts.agg(F.sum("df").alias("total"))  # one row
    each = with_df(found.select("group_id", F.explode("masked").alias("term")).where(F.col("term") != MASK), counts).crossJoin(F.broadcast(total))
    scores = each.groupBy("group_id").agg(F.avg(idf(F.col("df"), F.col("total"))).alias("score"))
    return found.join(scores, "group_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def stored_history(spark: SparkSession, config: Config) -> DataFrame:
    """(group_id, clock, value): lines of each group in each unit of time; lines without a time are not part."""
    rows = store_of(spark, config).read("groups").where("block > 0")
    return rows.groupBy("group_id", (F.col("block") * config.unit_secs).alias("clock")).agg(F.sum("count").cast("long").alias("value"))


def stored_tags(spark: SparkSession, config: Config) -> DataFrame:
    """(pattern_key, name, value): the latest value of each tag of each key."""
    rows = store_of(spark, config).read("pattern_tags")
    return rows.groupBy("pattern_key", "name").agg(F.max_by("value", F.struct("feed", "ord")).alias("value"))


def stored_patterns(spark: SparkSession, config: Config) -> DataFrame:
    """The patterns of all stored sessions, in the order in which their lines were fed."""
    records = store_of(spark, config).read("pattern_keys").withColumn("ord", F.struct("feed", "ord"))
    return patterns.detected(records, config.pattern_detection_mode, stored_tags(spark, config) if config.pattern_detection_mode == "relations" else None)


def stored_terms(spark: SparkSession, config: Config) -> DataFrame:
    return store_of(spark, config).read("terms").groupBy("term").agg(F.sum("df").cast("long").alias("df"))


def stream(spark: SparkSession, path: str, config: Config, checkpoint: str):
    """A streaming query that feeds new text files of a directory to the store; its checkpoint is the position."""

    def batch(rows: DataFrame, number: int) -> None:
        lines = rows.select(F.col("value").alias("line"), F.lit(0).cast("long").alias("file_epoch"), F.monotonically_increasing_id().alias("ord"))
        feed(lines, config, number)

    return spark.readStream.text(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streaming_counts(rows: DataFrame, time: str, unit: str, late: str, *by: str) -> DataFrame:
    """Tumbling counts of a stream: rows of each group in windows of event time, with a watermark for late rows."""
    return rows.withWatermark(time, late).groupBy(F.window(time, unit), *by).agg(F.count("*").alias("value"))


def feed_path(spark: SparkSession, config: Config, number: int, since: tuple[int, int] | None = None) -> None:
    """feed() of the log files of the settings."""
    feed(log_lines(spark, config.log_path, since), config, number)


def saved_position(lines: DataFrame) -> str:
    """The JSON of (last file's time, its lines), from which a later feed goes on."""
    last = lines.groupBy("file_epoch").agg(F.count("*").alias("rows")).orderBy(F.desc("file_epoch")).first()
    return json.dumps({"last_file_epoch": last["file_epoch"] if last else 0, "last_file_row": last["rows"] if last else 0})


__all__ = ["feed", "feed_path", "resume", "retain", "saved_position", "scored_groups", "store_of", "stored_groups", "stored_history", "stored_patterns", "stored_tags", "stored_terms", "stream", "streaming_counts"]
