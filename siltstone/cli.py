"""Command line: feed, groups, history, patterns, test and clean.

With a data folder, reports feed what is new in the logs and show what the store holds; without one,
they show the logs that are there.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.operators import history, patterns, templates
from siltstone.operators.parsing import parsed
from siltstone.operators.tokens import tokens
from siltstone.sources.readers import log_lines
from siltstone.sources.writers import bounded, group_report, pattern_report, write_groups, write_history, write_last_messages, write_patterns
from siltstone.streaming import feeds

COMMANDS = ("feed", "groups", "history", "patterns", "test", "clean")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("command", choices=COMMANDS, nargs="?", default="groups")
    p.add_argument("-c", "--config", default="")
    p.add_argument("-f", "--log-path", dest="log_path")
    p.add_argument("-d", "--data-dir", dest="data_dir")
    p.add_argument("-o", "--out-dir", dest="out_dir")
    p.add_argument("-s", "--search", action="append", default=[])
    p.add_argument("-x", "--exclude", action="append", default=[])
    p.add_argument("-N", dest="n", type=int, default=10)
    p.add_argument("--asc", action="store_true")
    p.add_argument("--min-count", type=int, default=0)
    p.add_argument("--max-count", type=int, default=0)
    p.add_argument("--group-id", type=int, default=0)
    p.add_argument("--line", default="")
    return p


def settings(args: argparse.Namespace) -> Config:
    config = Config()
    if args.config:
        with open(args.config) as text:
            config = Config.from_yaml(text.read())
    config = config.with_values({"log_path": args.log_path, "data_dir": args.data_dir, "out_dir": args.out_dir})
    stored = config.data_dir and args.command != "feed"  # reports feed all new lines, whatever they show
    if not config.search_regex and not config.exclude_regex and not stored:  # then they filter lines too
        config = config.with_values({"search_regex": args.search, "exclude_regex": args.exclude})
    return config


def session_patterns(messages: DataFrame, config: Config) -> DataFrame:
    """The patterns of sessions in parsed messages."""
    keyed = patterns.keys(messages, config.pattern_key_regexes).withColumn("tokens", tokens(F.col("msg"), config))
    masked = templates.masked_sequences(messages, config).select("tokens", F.xxhash64("masked").alias("group_id"))
    records = patterns.associated(keyed.join(masked, "tokens"))
    tags = patterns.key_tags(keyed) if config.pattern_detection_mode == "relations" else None
    return patterns.detected(records, config.pattern_detection_mode, tags)


def report(spark: SparkSession, config: Config):
    """Functions that make the groups, the history's cells and the patterns, of the store or of the logs."""
    if config.data_dir:
        if config.log_path:
            feeds.resume(spark, config)
        return lambda: feeds.scored_groups(spark, config), lambda: feeds.stored_history(spark, config), lambda: feeds.stored_patterns(spark, config)
    messages = parsed(log_lines(spark, config.log_path), config)

    def cells() -> DataFrame:
        rows = messages.withColumn("tokens", tokens(F.col("msg"), config))
        return history.group_history(rows, templates.masked_sequences(messages, config), config.unit_secs)

    return lambda: templates.groups(messages, config), cells, lambda: session_patterns(messages, config)


def explained(spark: SparkSession, line: str, config: Config) -> dict:
    """How one line is read: timestamp, message, tokens, pattern key and tags."""
    rows = parsed(spark.createDataFrame([(line,)], "line string"), config).withColumn("tokens", tokens(F.col("msg"), config))
    row = patterns.keys(rows, config.pattern_key_regexes).first()
    return {k: row[k] for k in ("epoch", "bucket", "msg", "tokens", "pattern_key", "tags")} if row else {}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Run a command; its report, which is printed too."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("siltstone").getOrCreate()
    config = settings(args)
    out: list[str] = []
    if args.command == "clean":
        feeds.store_of(spark, config).drop_all()
    elif args.command == "test":
        out = [f"{k}: {v}" for k, v in explained(spark, args.line, config).items()]
    elif args.command == "feed":
        feeds.resume(spark, config)
    else:
        groups, timeline, sessions = report(spark, config)
        found = templates.in_range(groups(), args.min_count, args.max_count, 0, args.search, args.exclude)
        ranked = templates.top(found, args.n, args.asc)
        if args.command == "groups":
            out = group_report(ranked)
            if config.out_dir:
                write_groups(ranked, f"{config.out_dir}/logGroups.csv")
                write_last_messages(ranked, f"{config.out_dir}/logGroups_last.csv")
        elif args.command == "history":
            cells = timeline()
            cells = cells.where(F.col("group_id") == args.group_id) if args.group_id else cells.join(F.broadcast(ranked.select("group_id")), "group_id", "left_semi") if args.n > 0 else cells
            if config.out_dir:
                write_history(cells, f"{config.out_dir}/history.csv", config.unit_secs)
            shown, more = bounded(cells.orderBy("group_id", "clock"), 10_000)
            out = [f"{r['group_id']} {r['clock']} {r['value']}" for r in shown] + more
        else:
            every = patterns.ranked(sessions(), args.n)
            if config.out_dir:
                write_patterns(every, groups(), f"{config.out_dir}/patterns.csv")
            out = pattern_report(every)
    print("\n".join(out))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
