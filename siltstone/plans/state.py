"""Queries of what is read and written: log files, reports, the store and feeds, and literals' functions.

Each writes below a new folder of the shared ones, and reads its result back from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions import scalars
from siltstone.functions.dialects import java_regex
from siltstone.functions.workspace import folder
from siltstone.operators import clusters, history, parsing, patterns, templates
from siltstone.plans import catalogue, sql
from siltstone.plans.catalogue import PLAIN, event_lines, event_messages, query, table, timed_events
from siltstone.sources import readers, store, writers
from siltstone.streaming import feeds

_STAMPED = r"^(?P<timestamp>\d+-\d+-\d+ \d+:\d+:\d+) (?P<message>.+)$"


def _log(spark, sf_dir, parity: int | None = None) -> DataFrame:
    """Events as lines of a log, without what parses as a second line; parity: those of every other event."""
    rows = event_lines(spark, sf_dir)
    return (rows if parity is None else rows.where(F.col("event_id") % 2 == parity)).select("line")


def _fed(spark, sf_dir, **settings) -> Config:
    """The settings of a store that has been fed twice, each time with half of the events."""
    at = folder(spark, "fed")
    config = Config(data_dir=f"{at}/data", log_path=f"{at}/logs/*", log_format=_STAMPED, timestamp_layout="2006-01-02 15:04:05").with_values({"unit_secs": 86400, "term_count_border": 5, **settings})
    for turn in (0, 1):
        _log(spark, sf_dir, turn).write.text(f"{at}/logs/{turn}")
        feeds.resume(spark, config)
    return config


_EVENT_DF = "with " + sql.EVENT_LINES + ", " + sql.token_table("{t}", f"(select event_id, {sql.NORMAL.format('substr(line, 21)')} as msg from lines)", "event_id") + ", " + sql.DF


# -- feeds and the store --------------------------------------------------------------------------------


@query(_EVENT_DF + " select term, df from df")
def feed_twice(spark, sf_dir):
    """Terms of two feeds from the command's function: the second goes on behind the files that the first has read."""
    return feeds.stored_terms(spark, _fed(spark, sf_dir))


@query("select count(*) as lines, floor(epoch(min(ts)))::bigint as created, floor(epoch(max(ts)))::bigint as updated from events")
def resume_position(spark, sf_dir):
    """All lines are counted once, though a third call reads all files again."""
    config = _fed(spark, sf_dir)
    feeds.resume(spark, config)
    return feeds.stored_groups(spark, config).agg(F.sum("count").cast("long").alias("lines"), F.min("created").alias("created"), F.max("updated").alias("updated"))


@query(f"select {sql.EVENT_DAY} as clock, count(*) as value from events group by all")
def stored_history(spark, sf_dir):
    return feeds.stored_history(spark, _fed(spark, sf_dir)).groupBy("clock").agg(F.sum("value").cast("long").alias("value"))


@query("select distinct user_id::varchar as pattern_key, 'kind' as name from events")
def stored_tags(spark, sf_dir):
    """Keys with their tags, of two feeds of a store."""
    return feeds.stored_tags(spark, _fed(spark, sf_dir, pattern_key_regexes=(r"(?P<kind>[a-z_]+) user=(?P<patternKey>\d+)",))).select("pattern_key", "name")


_BLOCKS = "blocks as (select floor(epoch(ts))::bigint // 86400 as block, count(*) as lines from events group by all)"


@query(f"with {_BLOCKS} select block, lines from blocks where block > (select max(block) from blocks) - 3")
def retention_store(spark, sf_dir):
    rows = feeds.store_of(spark, config := _fed(spark, sf_dir, keep_period=3)).read("groups")
    assert config.keep_period == 3
    return rows.groupBy("block").agg(F.sum("count").cast("long").alias("lines"))


@query(f"with {_BLOCKS} select block, lines from blocks order by block desc limit 4")
def retention_ring(spark, sf_dir):
    rows = feeds.store_of(spark, _fed(spark, sf_dir, max_blocks=4)).read("groups")
    return rows.groupBy("block").agg(F.sum("count").cast("long").alias("lines"))


def _event_store(spark, sf_dir) -> store.Store:
    """A store with a block for each day of events: written, then every third block put in place again as purchases only."""
    s = store.Store(spark, folder(spark, "store") + "/data", {"t": "block long, event_id long, event_type string, note string"})
    rows = timed_events(spark, sf_dir).select(F.floor(F.col("epoch") / 86400).alias("block"), "event_id", "event_type")
    s.create("t")
    s.append("t", rows.where("event_id % 2 = 0"))
    s.append("t", rows.where("event_id % 2 = 1"))
    s.overwrite_blocks("t", rows.where("block % 3 = 0 and event_type = 'purchase'"))
    return s


_STORED = """days as (select floor(epoch(ts))::bigint // 86400 as block, event_id, event_type from events),
again as (select distinct block from days where block % 3 = 0 and event_type = 'purchase'),
t as (select * from days where block not in (select block from again) or event_type = 'purchase')"""


@query(f"with {_STORED} select block, event_id, event_type, null::varchar as note from t")
def store_tables(spark, sf_dir):
    return _event_store(spark, sf_dir).read("t")


@query(f"with {_STORED} select block, count(*) as rows, block < (select max(block) from t) as completed from t group by block")
def block_status(spark, sf_dir):
    return _event_store(spark, sf_dir).status("t")


@query(f"with {_STORED} select event_type, count(*) as count from t where block < (select max(block) from t) group by event_type")
def completed_scan(spark, sf_dir):
    return _event_store(spark, sf_dir).read_completed("t").groupBy("event_type").agg(F.count("*").alias("count"))


@query(f"with {_STORED} select block, event_type, count(*) as count from t where block in (select block from (select distinct block from t order by block limit 2)) group by all")
def store_some_blocks(spark, sf_dir):
    s = _event_store(spark, sf_dir)
    return s.read("t", s.blocks("t")[:2]).groupBy("block", "event_type").agg(F.count("*").alias("count"))


@query(f"with {_STORED} select block, event_type, count(*) as count from t where block > (select max(block) from t) - 2 group by all")
def store_retain(spark, sf_dir):
    s = _event_store(spark, sf_dir)
    s.retain("t", 2)
    return s.read("t").groupBy("block", "event_type").agg(F.count("*").alias("count"))


# -- sources ---------------------------------------------------------------------------------------------


@query(sql.chain(sql.EVENT_LINES, select="select event_id % 2 as file, count(*) as lines, min(line) as low, max(line) as high from lines group by all"))
def log_scan(spark, sf_dir):
    """Log files, one of them compressed, read back with their lines."""
    at = folder(spark, "logs")
    _log(spark, sf_dir, 0).coalesce(1).write.text(f"{at}/0")
    _log(spark, sf_dir, 1).coalesce(1).write.option("compression", "gzip").text(f"{at}/1")
    rows = readers.log_lines(spark, f"{at}/*")
    return rows.groupBy(F.regexp_extract("source", r"/(\d)/[^/]*$", 1).cast("long").alias("file")).agg(F.count("*").alias("lines"), F.min("line").alias("low"), F.max("line").alias("high"))


@query(sql.chain(sql.EVENT_LINES, select="select event_id, row_number() over (order by ts, event_id) - 1 as nr from lines"))
def log_order(spark, sf_dir):
    """The number of each line in a file, which follows the file's order."""
    at = folder(spark, "ordered")
    rows = event_lines(spark, sf_dir).orderBy("ord").select(F.concat(F.col("event_id").cast("string"), F.lit(" "), "line"))
    rows.coalesce(1).write.text(at)
    found = readers.numbered(readers.log_lines(spark, at))
    return found.select(F.regexp_extract("line", r"^(\d+) ", 1).cast("long").alias("event_id"), F.col("nr").alias("nr"))


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def csv_scan(spark, sf_dir):
    at, rows = folder(spark, "csv"), table(spark, sf_dir, "supplier")
    rows.write.option("compression", "gzip").option("header", True).csv(at)
    return readers.separated(spark, at, header=True, schema="s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("select p_partkey::varchar as _c0, p_name as _c1, p_size::varchar as _c2 from part")
def separated_scan(spark, sf_dir):
    at = folder(spark, "separated")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").write.option("sep", "|").csv(at)
    return readers.separated(spark, at, "|")


@query(f"with cells as (select event_type, {sql.EVENT_DAY} as time, count(*)::double as value from events group by all) select time, max(case when event_type = 'purchase' then value end) as purchase, max(case when event_type = 'signup' then value end) as signup from cells where event_type in ('purchase', 'signup') group by time")
def metrics_pivot(spark, sf_dir):
    at = folder(spark, "metrics")
    cells = history.counted(timed_events(spark, sf_dir), 86400, "event_type").where("event_type in ('purchase', 'signup')")
    points = F.collect_list(F.array(F.col("value").cast("double"), F.col("clock").cast("double")))  # a point a day
    cells.groupBy(F.col("event_type").alias("metric")).agg(points.alias("datapoints")).agg(F.to_json(F.collect_list(F.struct("metric", "datapoints"))).alias("value")).write.text(at)  # one document, of two metrics
    return readers.metrics(spark, at)


@query("select distinct p_brand as line from part")
def text_lines(spark, sf_dir):
    at = folder(spark, "lines")
    writers.write_lines(table(spark, sf_dir, "part").select("p_brand").distinct(), at)
    return readers.log_lines(spark, at).select("line")


# -- reports ----------------------------------------------------------------------------------------------


def _report(spark, at: str) -> DataFrame:
    return spark.read.option("header", True).csv(at)


@query(sql.chain(*catalogue._EVENT_CHAIN, select="select count::varchar as count, groups from (select count(*) as count, template from found group by template) t(count, template), (select count(distinct template)::bigint as groups from found)"))
def group_csv(spark, sf_dir):
    at = folder(spark, "report") + "/logGroups.csv"
    writers.write_groups(templates.top(templates.groups(event_messages(spark, sf_dir), PLAIN), 0), at)
    rows = _report(spark, at)
    return rows.crossJoin(F.broadcast(rows.agg(F.count_distinct("group_id").alias("groups")))).select("count", "groups")  # one row


@query(sql.chain(*catalogue._EVENT_CHAIN, select="select strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_update, count(*)::varchar as count, arg_max(line, (ts, event_id)) as text from found group by template"))
def last_message_csv(spark, sf_dir):
    at = folder(spark, "report") + "/logGroups_last.csv"
    writers.write_last_messages(templates.groups(event_messages(spark, sf_dir), PLAIN), at)
    return _report(spark, at).select("last_update", "count", "text")


def _user_cells(spark, sf_dir) -> DataFrame:
    return history.counted(timed_events(spark, sf_dir), 86400, "user_id").withColumnRenamed("user_id", "group_id")


@query(f"select user_id::varchar as itemid, ({sql.EVENT_DAY})::varchar as clock, count(*)::varchar as value from events group by all")
def history_csv(spark, sf_dir):
    at = folder(spark, "report") + "/history.csv"
    writers.write_history(_user_cells(spark, sf_dir), at, 86400)
    return _report(spark, at)


@query(f"select max({sql.EVENT_DAY}) as end, min({sql.EVENT_DAY}) as start, 86400::bigint as unit_secs from events")
def history_info(spark, sf_dir):
    at = folder(spark, "report")
    writers.write_history(_user_cells(spark, sf_dir), f"{at}/history.csv", 86400)
    return spark.read.schema("start long, end long, unit_secs long").json(f"{at}/history_info.json").select("end", "start", "unit_secs")


#: Event types by a number that any dialect can make: the length, and the first letter's code.
_NUMBER = "length(event_type) * 1000 + ascii(event_type)"
_REPORTED = f"""seg as (select user_id::varchar as key, ts, event_id, ({_NUMBER})::varchar as g, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as segment from events),
parts as (select key, segment, string_agg(g, ' ' order by ts, event_id) as pattern, floor(epoch(min(ts)))::bigint as start from seg group by all),
found as (select pattern, key, arg_min(start, segment) as start_epoch, count(*) as cnt from parts group by all),
totals as (select pattern, sum(cnt)::bigint as total from found group by pattern having sum(cnt) >= 2)"""


def _numbered_records(spark, sf_dir) -> DataFrame:
    e = timed_events(spark, sf_dir)
    return e.select(F.col("user_id").cast("string").alias("pattern_key"), F.struct("ts", "event_id").alias("ord"), "epoch", (F.col("event_type") == "signup").alias("matched"), F.expr(_NUMBER).alias("group_id"))


def _written_patterns(spark, sf_dir) -> str:
    at = folder(spark, "report") + "/patterns.csv"
    displays = table(spark, sf_dir, "events").select(F.expr(_NUMBER).cast("long").alias("group_id"), F.col("event_type").alias("display")).distinct()
    writers.write_patterns(patterns.ranked(patterns.first_match(_numbered_records(spark, sf_dir)), 2), displays, at)
    return at


@query(sql.chain(_REPORTED, select="select total::varchar as total, found.pattern, key, start_epoch::varchar as start_epoch, cnt::varchar as cnt from found join totals on totals.pattern = found.pattern"))
def pattern_csv(spark, sf_dir):
    return _report(spark, _written_patterns(spark, sf_dir))


@query(sql.chain(_REPORTED, "used as (select distinct unnest(string_split(pattern, ' ')) as group_id from totals)", select=f"select distinct used.group_id, event_type as display from used join events on ({_NUMBER})::varchar = used.group_id"))
def pattern_groups_csv(spark, sf_dir):
    return _report(spark, _written_patterns(spark, sf_dir).removesuffix(".csv") + "_groups.csv")


# -- sessions ----------------------------------------------------------------------------------------------


@query(sql.chain(catalogue._SEGMENTS, select="select pattern, key, start_epoch, cnt from found where key in ('1', '5', '9')"))
def key_list_filter(spark, sf_dir):
    return patterns.first_match(patterns.of_keys(catalogue._event_records(spark, sf_dir), ["1", "5", "9"]))


@query(sql.chain(catalogue._SEGMENTS, "w as (select user_id::varchar as key, string_agg(event_type, ' ' order by ts, event_id) as pattern, floor(epoch(arg_min(ts, (ts, event_id))))::bigint as start from events group by 1)", select="select 'firstMatch' as mode, pattern, key, start_epoch, cnt from found union all select 'relations', pattern, 'all', min(start), count(*) from w group by pattern"))
def detection_modes(spark, sf_dir):
    records = catalogue._event_records(spark, sf_dir)
    found = [patterns.detected(records, mode).withColumn("mode", F.lit(mode)) for mode in ("firstMatch", "relations")]
    return found[0].unionByName(found[1]).select("mode", "pattern", "key", "start_epoch", "cnt")


@query("select conv_id::varchar as pattern_key, string_agg(name || ':' || value, ', ' order by name) as relation from (select conv_id, 'first' as name, arg_min(role, (turn, text)) as value from conversations where conv_id is not null group by 1 union all select conv_id, 'last', arg_max(role, (turn, text)) from conversations where conv_id is not null group by 1) group by conv_id")
def tag_relations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.col("conv_id").isNotNull())
    ends = c.groupBy(F.col("conv_id").cast("string").alias("pattern_key")).agg(F.min_by("role", F.struct("turn", "text")).alias("first"), F.max_by("role", F.struct("turn", "text")).alias("last"))
    return patterns.tag_strings(ends.select("pattern_key", F.explode(F.create_map(F.lit("first"), F.col("first"), F.lit("last"), F.col("last"))).alias("name", "value")))


# -- parsing and scalars -----------------------------------------------------------------------------------


_RULES = Config(log_format=r"^(?P<timestamp>\S+) (?P<message>[a-z]+ .*)$", timestamp_layout="2006-01-02T15:04:05", unit_secs=3600)
_ODD = """odd as (select event_id, epoch(date_trunc('second', ts))::bigint as t, case event_id % 5 when 0 then '' when 1 then '   ' when 2 then 'UPPER only' when 3 then '2024-99-99T00:00:00 bad date' else strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' good  one' end as line from events)"""


@query(
    sql.chain(
        _ODD,
        select="""select event_id, case event_id % 5 when 3 then '2024-99-99T00:00:00 bad date' when 4 then 'good one' else '' end as msg,
case event_id % 5 when 3 then 77 when 4 then t else 0 end as epoch, case event_id % 5 when 4 then (t // 3600) * 3600 else 0 end as bucket from odd""",
    )
)
def parse_rules(spark, sf_dir):
    """Blank lines, lines that the format doesn't match, times that can't be parsed, and good ones."""
    e = timed_events(spark, sf_dir)
    texts = F.array(F.lit(""), F.lit("   "), F.lit("UPPER only"), F.lit("2024-99-99T00:00:00 bad date"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" good  one")))
    rows = e.select("event_id", texts[(F.col("event_id") % 5).cast("int")].alias("line"), F.lit(77).cast("long").alias("file_epoch"))
    return parsing.parsed(rows, _RULES).select("event_id", "msg", "epoch", "bucket")


@query("select event_id, epoch(date_trunc('second', ts) - case when month(ts) > 6 then to_years(year(ts)::int - 2024 + 1) else to_years(year(ts)::int - 2024) end)::bigint as epoch from events where strftime(ts, '%m-%d') <> '02-29'")
def partial_dates(spark, sf_dir):
    """Ordinal days and no year: that of a fixed now, or the one before if the month were later."""
    now = F.lit("2024-06-30 00:00:00").cast("timestamp")
    day = F.dayofmonth("ts")
    suffix = F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th")
    rows = table(spark, sf_dir, "events").where(F.date_format("ts", "MM-dd") != "02-29")
    text = F.concat(F.date_format("ts", "MMM "), day.cast("string"), suffix, F.date_format("ts", " HH:mm:ss"))
    return rows.select("event_id", scalars.parse_date(text, "Jan 2th 15:04:05", now).alias("epoch"))


@query("select event_id, epoch(date_trunc('second', ts))::bigint as epoch from events")
def timestamps_utc(spark, sf_dir):
    text = F.date_format("ts", "dd/MMM/yyyy HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", scalars.timestamp_utc(text, "02/Jan/2006 15:04:05").alias("epoch"))


@query("select event_id, case event_id % 3 when 0 then 86400 when 1 then 3600 else 60 end::bigint as seconds, case event_id % 3 when 0 then strftime(ts, '%Y-%m-%d') when 1 then strftime(ts, '%Y-%m-%d %H') else strftime(ts, '%Y-%m-%d %H:%M') end as shown from events")
def unit_helpers(spark, sf_dir):
    rows, out = timed_events(spark, sf_dir), None
    for k, unit in enumerate(("day", "hour", "minute")):
        seconds = scalars.unit_seconds(unit)
        part = rows.where(F.col("event_id") % 3 == k).select("event_id", F.lit(seconds).cast("long").alias("seconds"), scalars.epoch_to_string(F.col("epoch"), scalars.datetime_format(seconds)).alias("shown"))
        out = part if out is None else out.union(part)
    return out


@query("select o_orderkey, o_orderkey::varchar || '/' || o_custkey::varchar || '/' || (o_orderkey % 7)::varchar as text, case when o_orderkey <= o_custkey then 'a' else 'b' end as least from orders")
def number_strings(spark, sf_dir):
    values = F.array("o_orderkey", "o_custkey", F.col("o_orderkey") % 7)
    first = scalars.sorted_places(F.array("o_orderkey", "o_custkey"))[0]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(scalars.strings(values), "/").alias("text"), F.when(first == 0, "a").otherwise("b").alias("least"))


@query("select p_partkey, regexp_matches(p_name, '^[a-zA-Z]+ [a-zA-Z]+') as named, regexp_extract(p_brand, '([0-9]+)', 1) as digits from part")
def foreign_regexes(spark, sf_dir):
    """Named groups and POSIX classes in the dialect of the settings."""
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").rlike(java_regex("^[[:alpha:]]+ (?P<second>[[:alpha:]]+)")).alias("named"), F.regexp_extract("p_brand", java_regex("(?P<digits>[[:digit:]]+)"), 1).alias("digits"))


# -- clusters ------------------------------------------------------------------------------------------------

_ROUND = "a{0} as (select id, arg_min(cluster, (round(d, 9), cluster)) as cluster from (select v.id, c.cluster, sqrt(sum((v.x - c.x) * (v.x - c.x))) as d from v join c{0} c on c.k = v.k group by all) group by id)"
_MEAN = "c{1} as (select a.cluster, v.k, avg(v.x) as x from v join a{0} a on a.id = v.id group by all)"


@query(sql.chain(sql.VECTORS, "c0 as (select (row_number() over (partition by k order by id) - 1)::int as cluster, k, x from v where id in (select vec_id from embeddings order by vec_id limit 6))", _ROUND.format(0), _MEAN.format(0, 1), _ROUND.format(1), _MEAN.format(1, 2), _ROUND.format(2), select="select id, cluster from a2"))
def kmeans(spark, sf_dir):
    """Two rounds from fixed first centres, the vectors of the six smallest ids."""
    v = catalogue._vectors(spark, sf_dir)
    first = v.orderBy("id").limit(6)
    first = first.select((F.row_number().over(Window.orderBy("id")) - 1).alias("cluster"), F.col("vector").cast("array<double>").alias("centroid"))  # six rows
    return clusters.lloyd(v, first, 2).select("id", "cluster")
