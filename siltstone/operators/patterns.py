"""Session patterns: keys and tags in lines, lines of each key, and sequences of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.dialects import group_names, java_regex

KEY = "patternKey"


def keys(lines: DataFrame, regexes) -> DataFrame:
    """lines with pattern_key (of the last regex that matches, else null) and tags (a map of the other named groups of all that match)."""
    key, tags = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    for pattern in regexes:
        names = group_names(pattern)
        if KEY not in names:
            raise ValueError(f"a pattern without a {KEY} group: {pattern}")
        hit = F.col("text").rlike(java_regex(pattern))
        key = F.when(hit, F.regexp_extract("text", java_regex(pattern), names[KEY])).otherwise(key)
        own = [x for name, k in sorted(names.items()) if name != KEY for x in (F.lit(name), F.regexp_extract("text", java_regex(pattern), k))]
        if own:
            tags = _merged(tags, hit, own)
    return lines.withColumns({"pattern_key": key, "tags": tags})


def _merged(tags: Column, hit: Column, own: list[Column]) -> Column:
    """tags with the names and values of own in place of earlier ones, where hit."""
    names = F.array(*own[::2])
    rest = F.map_filter(tags, lambda k, v: ~F.array_contains(names, k))
    return F.when(hit, F.map_concat(rest, F.create_map(*own))).otherwise(tags)


def key_tags(keyed: DataFrame) -> DataFrame:
    """(pattern_key, name, value): the latest value of each tag of each key. keyed: pattern_key, tags, ord."""
    rows = keyed.where(F.col("pattern_key").isNotNull()).select("pattern_key", "ord", F.explode("tags").alias("name", "value"))
    return rows.groupBy("pattern_key", "name").agg(F.max_by("value", "ord").alias("value"))


def tag_strings(tags: DataFrame) -> DataFrame:
    """(pattern_key, relation): a key's tags as 'name:value, name:value', by name."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("name", "value"))), lambda t: F.concat(t["name"], F.lit(":"), t["value"]))
    return tags.groupBy("pattern_key").agg(F.array_join(each, ", ").alias("relation"))


def associated(keyed: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(pattern_key, ord, epoch, matched, group_id; block if there) of lines that belong to a session.

    keyed: ord, epoch, tokens, group_id, pattern_key. A line belongs to the key that is one of its tokens
    and was seen in a line up to this one; of several, to that of the last token. matched: the line
    itself has a key. Keys are compared in lower case, as tokens are. earlier (pattern_key): keys that
    were seen before all of these lines.
    """
    first = keyed.where(F.col("pattern_key").isNotNull()).groupBy(F.lower("pattern_key").alias("key")).agg(F.min("ord").alias("since"), F.min_by("pattern_key", "ord").alias("name"))
    if earlier is not None:
        old = earlier.groupBy(F.lower("pattern_key").alias("key")).agg(F.min("pattern_key").alias("old"))
        first = first.join(old, "key", "full").select("key", F.when(F.col("old").isNull(), F.col("since")).alias("since"), F.coalesce("old", "name").alias("name"))
    carried = ["epoch", "matched", "group_id", *(["block"] if "block" in keyed.columns else [])]
    parts = keyed.withColumn("matched", F.col("pattern_key").isNotNull()).select("ord", *carried, F.posexplode("tokens").alias("pos", "key"))
    found = parts.join(first, "key").where("since is null or ord >= since")
    return found.groupBy("ord").agg(F.max_by("name", "pos").alias("pattern_key"), *[F.first(c).alias(c) for c in carried]).select("pattern_key", "ord", *carried)


def _sequence(by: list[str], rows: DataFrame) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "group_id"))), lambda s: s["group_id"].cast("string"))
    return rows.groupBy(*by).agg(F.array_join(ordered, " ").alias("pattern"), F.min_by("epoch", "ord").alias("start"))


def first_match(records: DataFrame) -> DataFrame:
    """(pattern, key, start_epoch, cnt): sequences of groups from one matched line of a key to before the next.

    records: pattern_key, ord, epoch, matched, group_id. start_epoch is that of the first such segment.
    """
    order = Window.partitionBy("pattern_key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    parts = records.withColumn("segment", F.sum(F.col("matched").cast("int")).over(order))
    segments = _sequence(["pattern_key", "segment"], parts)
    return segments.groupBy("pattern", F.col("pattern_key").alias("key")).agg(F.min_by("start", "segment").alias("start_epoch"), F.count("*").alias("cnt"))


def relations(records: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(pattern, key, start_epoch, cnt): a key's whole sequence, counted by the keys' tag string ('all' without tags)."""
    whole = _sequence(["pattern_key"], records)
    named = whole.join(tag_strings(tags), "pattern_key", "left") if tags is not None else whole.withColumn("relation", F.lit(None).cast("string"))
    return named.groupBy("pattern", F.coalesce("relation", F.lit("all")).alias("key")).agg(F.min("start").alias("start_epoch"), F.count("*").alias("cnt"))


def detected(records: DataFrame, mode: str, tags: DataFrame | None = None) -> DataFrame:
    """first_match or relations, by the mode's name."""
    if mode == "firstMatch":
        return first_match(records)
    if mode == "relations":
        return relations(records, tags)
    raise ValueError(f"unknown pattern detection mode {mode!r}")


def ranked(found: DataFrame, least: int = 1) -> DataFrame:
    """Patterns whose counts over all keys add up to at least `least`, with that total, the most frequent first."""
    total = F.sum("cnt").over(Window.partitionBy("pattern"))
    return found.withColumn("total", total).where(F.col("total") >= least).orderBy(F.desc("total"), "pattern", F.desc("cnt"), "key")


def of_keys(records: DataFrame, wanted: list[str]) -> DataFrame:
    """The records of some keys."""
    return records.where(F.col("pattern_key").isin(wanted))
