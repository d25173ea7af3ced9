"""The named queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions import scalars
from siltstone.functions.workspace import folder, spread, stored
from siltstone.operators import clusters, history, matching, parsing, patterns, tables, templates, terms
from siltstone.operators import tokens as tok
from siltstone.plans import sql
from siltstone.sources import store
from siltstone.sources.readers import document_lines
from siltstone.streaming import feeds

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
PLAIN = Config()
EVENT_FORMAT = Config(log_format=r"^(?P<timestamp>\d+-\d+-\d+ \d+:\d+:\d+) (?P<message>.+)$", timestamp_layout="2006-01-02 15:04:05")


def query(text: str | None):
    """Register a query by its function's name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if text:
            _SQL[f.__name__] = text
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from siltstone.plans import state  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: _SQL[name] for name in queries() if name in _SQL}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ln and msg of the lines of documents."""
    lines = document_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return parsing.parsed(lines, PLAIN).select("doc_id", "ln", "msg")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ord and line: events as log lines."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" "), F.coalesce("props", F.lit("")))
    return e.select("event_id", F.struct("ts", "event_id").alias("ord"), line.alias("line"))


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("epoch", F.unix_timestamp("ts"))


# -- templates ---------------------------------------------------------------------------------------------


@query(sql.chain(sql.LINES, sql.token_table(), sql.DF, sql.BORDER, sql.masked(), select=sql.COUNTS))
def templates_(spark, sf_dir):
    return templates.templates(messages(spark, sf_dir), PLAIN)


_QUERIES["templates"], _SQL["templates"] = _QUERIES.pop("templates_"), _SQL.pop("templates_")


_SCORED = (
    sql.LINES, sql.token_table(), sql.DF, sql.BORDER, sql.masked(),
    "every as (select sum(df)::double as every from df)",
    "open as (select template, m, d, every, list_filter(generate_series(1, len(m)), lambda i: m[i] <> '*') as o from found, every)",
    "scored as (select template, count(*) as count, coalesce(round(max(case when len(o) > 0 then list_sum(list_transform(o, lambda i: ln(every / d[i]) + 1)) / len(o) else 0 end), 5), 0) as score from open group by template)",
)


@query(sql.chain(*_SCORED, select="select template, count, score from scored order by count desc, score, template limit 20"))
def top_templates(spark, sf_dir):
    found = templates.masked_sequences(messages(spark, sf_dir).select("msg"), PLAIN)
    found = found.groupBy(F.array_join("masked", " ").alias("group_id")).agg(F.sum("lines").cast("long").alias("count"), F.round(F.max("score"), 5).alias("score"))
    return templates.top(found, 20).select(F.col("group_id").alias("template"), "count", "score")


@query(sql.chain(sql.LINES, sql.token_table(), sql.DF, select="select term, df from df"))
def term_df(spark, sf_dir):
    return terms.term_counts(templates.sequences(messages(spark, sf_dir), PLAIN))


@query(sql.chain(sql.LINES, sql.token_table(), sql.DF, sql.BORDER, select="select border from border"))
def term_border(spark, sf_dir):
    return terms.border(stored(term_df(spark, sf_dir), "terms"), PLAIN.term_count_border_rate)


@query(sql.chain(sql.LINES, sql.token_table(), sql.DF, sql.BORDER, sql.masked(), select="select doc_id, ln, coalesce(line_border, (select border from border)) as line_border from tok left join edge on edge.id = tok.id"))
def line_border(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("tokens", tok.tokens(F.col("msg"), PLAIN))
    found = templates.masks(templates.sequences(rows.select("msg"), PLAIN), PLAIN)
    return rows.join(found, "tokens").select("doc_id", "ln", F.col("border_line").alias("line_border"))


@query(sql.chain(sql.LINES, sql.token_table(), sql.DF, select="select term, round(ln((select sum(df) from df) / df) + 1, 6) as idf from df"))
def term_idf(spark, sf_dir):
    counts = stored(term_df(spark, sf_dir), "terms")
    total = counts.agg(F.sum("df").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("term", F.round(terms.idf(F.col("df"), F.col("total")), 6).alias("idf"))


@query(
    sql.chain(
        sql.LINES, sql.token_table(), sql.DF, sql.BORDER, sql.masked(),
        "every as (select sum(df)::double as every from df)",
        "open as (select distinct template, m, d, every, list_filter(generate_series(1, len(m)), lambda i: m[i] <> '*') as o from found, every)",
        select="""select template, coalesce(round(max(case when len(o) > 0 then list_sum(list_transform(o, lambda i: ln(every / d[i]) + 1)) / len(o) else 0 end), 5), 0) as score from open group by template""",
    )
)
def template_score(spark, sf_dir):
    found = templates.masked_sequences(messages(spark, sf_dir).select("msg"), PLAIN)
    return found.groupBy(F.array_join("masked", " ").alias("template")).agg(F.round(F.max("score"), 5).alias("score"))


@query(sql.chain(sql.LINES, select="select doc_id, ln, msg from lines where regexp_matches(msg, 'the|der|les') and regexp_matches(msg, 'in') and not regexp_matches(msg, 'stupid|[0-9]{4}')"))
def include_exclude_filter(spark, sf_dir):
    rows = messages(spark, sf_dir)
    return rows.where(parsing.matches(F.col("msg"), ("the|der|les", "in"), ("stupid|[0-9]{4}",)))


@query(sql.chain(sql.EVENT_LINES, select="select event_id, floor(epoch(ts))::bigint as epoch, (floor(epoch(ts))::bigint // 86400) * 86400 as bucket, regexp_extract(" + sql.NORMAL.format("line") + ", '^\\d+-\\d+-\\d+ \\d+:\\d+:\\d+ (.+)$', 1) as msg from lines"))
def parse_timestamp_message(spark, sf_dir):
    return parsing.parsed(event_lines(spark, sf_dir), EVENT_FORMAT).select("event_id", "epoch", "bucket", "msg")


_FORMATS = (r"^\w+ (?P<message>user=.*)$", r"^user=\d*0 (?P<message>.*)$")


@query(
    sql.chain(
        sql.EVENT_LINES,
        "a as (select event_id, regexp_extract(" + sql.NORMAL.format("line") + ", '^\\d+-\\d+-\\d+ \\d+:\\d+:\\d+ (.+)$', 1) as m from lines)",
        "b as (select event_id, case when regexp_matches(m, '^\\w+ (user=.*)$') then regexp_extract(m, '^\\w+ (user=.*)$', 1) else m end as m from a)",
        select="select event_id, case when regexp_matches(m, '^user=\\d*0 (.*)$') then regexp_extract(m, '^user=\\d*0 (.*)$', 1) else m end as msg from b",
    )
)
def message_format_chain(spark, sf_dir):
    return parsing.parsed(event_lines(spark, sf_dir), replace(EVENT_FORMAT, msg_formats=_FORMATS)).select("event_id", "msg")


@query(sql.chain(sql.LINES, sql.token_table(), select="select doc_id, ln, array_to_string(t, ' ') as tokens, len(t)::int as n from tok"))
def tokenize(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("t", tok.tokens(F.col("msg"), PLAIN))
    return rows.select("doc_id", "ln", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


def _variant(config: Config, rule: str, keep: str = "false", border: str = "(select border from border)"):
    text = sql.chain(sql.LINES, sql.token_table(rule), sql.DF, sql.BORDER, sql.masked(keep, border=border), select=sql.COUNTS)

    def run(spark, sf_dir):
        return templates.templates(messages(spark, sf_dir), config)

    return run, text


_VARIANTS = {
    "ignore_words": (Config(ignorewords=("the", "der", "les")), "case when x in ('the', 'der', 'les') then '*' else {t} end", "false"),
    "keywords": (Config(keywords=("idiot", "scum", "license")), "{t}", "k.term in ('idiot', 'scum', 'license')"),
    "key_regexes": (Config(key_regexes=("^th.*ing$",)), "{t}", "regexp_matches(k.term, '^th.*ing$')"),
    "ignore_numbers": (Config(ignore_numbers=True), "case when regexp_matches({t}, '^\\p{{Nd}}+(\\.\\p{{Nd}}+)?$') then '*' else {t} end", "false"),
    "ignore_regex": (Config(ignore_regexes=("^on.*er$",)), "case when regexp_matches(x, '^on.*er$') then '*' else {t} end", "false"),
}
for _name, (_config, _rule, _keep) in _VARIANTS.items():
    _QUERIES[_name], _SQL[_name] = _variant(_config, _rule, _keep)
_QUERIES["fixed_border"], _SQL["fixed_border"] = _variant(Config(term_count_border=5), "{t}", border="5")


_EVENT_TOKENS = sql.token_table("{t}", f"(select event_id, {sql.NORMAL.format('substr(line, 21)')} as msg from lines)", "event_id")


@query(
    sql.chain(
        sql.EVENT_LINES, _EVENT_TOKENS, sql.DF, sql.BORDER, sql.masked(),
        select=f"""select event_id, array_to_string(list_transform(regexp_extract_all(msg, '([^{sql._CLASS}]+|[{sql._CLASS}])'), lambda p: case when list_contains(list_transform(list_filter(generate_series(1, len(t)), lambda i: m[i] = '*'), lambda i: t[i]), lower(p)) then '*' else p end), '') as display from found""",
    )
)
def display_string(spark, sf_dir):
    rows = event_messages(spark, sf_dir).withColumn("tokens", tok.tokens(F.col("msg"), PLAIN))
    found = templates.masks(templates.sequences(rows.select("msg"), PLAIN), PLAIN)
    hidden = F.filter(F.zip_with("tokens", "masked", lambda t, m: F.when(m == tok.MASK, t)), lambda x: x.isNotNull())
    return rows.join(found, "tokens").select("event_id", tok.display(F.col("msg"), hidden, PLAIN.separators).alias("display"))


def event_messages(spark, sf_dir):
    """event_id, ord, epoch, msg and line of events as log lines."""
    rows = parsing.parsed(event_lines(spark, sf_dir), EVENT_FORMAT)
    return rows.select("event_id", "ord", "epoch", "bucket", "msg", "line", "text")


_EVENT_CHAIN = (sql.EVENT_LINES, sql.token_table("{t}", f"(select event_id, ts, line, {sql.NORMAL.format('substr(line, 21)')} as msg from lines)", "event_id, ts, line"), sql.DF, sql.BORDER, sql.masked())


@query(sql.chain(*_EVENT_CHAIN, select="select template, count(*) as count, floor(epoch(min(ts)))::bigint as created, floor(epoch(max(ts)))::bigint as updated, arg_max(line, (ts, event_id)) as last_message from found group by template"))
def groups(spark, sf_dir):
    found = templates.groups(event_messages(spark, sf_dir), PLAIN)
    return found.select(F.array_join("masked", " ").alias("template"), "count", "created", "updated", "last_message")


@query(sql.chain(*_EVENT_CHAIN, select="select template, count(*) as count from found group by template having count(*) between 2 and 50"))
def count_range_filter(spark, sf_dir):
    found = templates.in_range(templates.groups(event_messages(spark, sf_dir), PLAIN), 2, 50)
    return found.select(F.array_join("masked", " ").alias("template"), "count")


@query(sql.chain(sql.LINES, sql.token_table(), sql.DF, sql.BORDER, sql.masked(), select="select template, count(*) as count from found where regexp_matches(template, 'the') and not regexp_matches(template, 'of') group by template"))
def output_filter(spark, sf_dir):
    found = templates.templates(messages(spark, sf_dir), PLAIN)
    return found.where(parsing.matches(F.col("template"), ("the",), ("of",)))


@query(
    sql.chain(
        sql.LINES, sql.token_table(), sql.DF, sql.BORDER, sql.masked(), "first as (select template as msg, count(*) as c from found group by template)",
        "again as (with " + sql.token_table("{t}", "first", "c") + ", df as (select term, sum(c)::bigint as df from (select c, unnest(list_distinct(t)) as term from tok) where term <> '*' group by term), " + sql.masked(match=0.3, border="3") + " select * from found)",
        select="select template, sum(c)::bigint as count from again group by template",
    )
)
def regroup_new_border(spark, sf_dir):
    found = templates.masked_sequences(messages(spark, sf_dir).select("msg"), PLAIN)  # groups in parts
    rows = found.select(F.array_join("masked", " ").alias("display"), F.col("lines").alias("count"), F.lit(0).cast("long").alias("created"), F.lit(0).cast("long").alias("updated"))
    return templates.regrouped(rows, Config(term_count_border=3, min_match_rate=0.3)).select("template", "count")


# -- history -----------------------------------------------------------------------------------------------


@query(f"select event_type, {sql.EVENT_DAY} as clock, count(*) as value from events group by all")
def history_daily(spark, sf_dir):
    return history.counted(timed_events(spark, sf_dir), 86400, "event_type")


@query(f"select event_type, {sql.EVENT_HOUR} as clock, count(*) as value from events group by all")
def history_hourly(spark, sf_dir):
    return history.counted(timed_events(spark, sf_dir), 3600, "event_type")


@query(sql.chain(*_EVENT_CHAIN, select=f"select template, {sql.EVENT_DAY} as clock, count(*) as value from found group by all"))
def group_history(spark, sf_dir):
    rows = event_messages(spark, sf_dir).withColumn("tokens", tok.tokens(F.col("msg"), PLAIN))
    found = templates.masks(templates.sequences(rows.select("msg"), PLAIN), PLAIN)
    cells = history.counted(rows, 86400, "tokens").join(found, "tokens")
    return cells.groupBy(F.array_join("masked", " ").alias("template"), "clock").agg(F.sum("value").cast("long").alias("value"))


@query(sql.chain(sql.DENSE, select="select event_type, clock, value from series"))
def history_dense(spark, sf_dir):
    return history.dense(history_hourly(spark, sf_dir), 3600, "event_type")


@query(
    f"""with cells as (select user_id, {sql.EVENT_DAY} as clock, count(*) as value from events group by all),
best as (select user_id from cells group by user_id order by sum(value) desc, user_id limit 10)
select user_id, clock, value from cells semi join best using (user_id)"""
)
def history_topn(spark, sf_dir):
    return history.largest(history.counted(timed_events(spark, sf_dir), 86400, "user_id"), "user_id", 10)


@query(sql.chain(sql.DENSE, "asked as (select event_type, unnest([0, (select min(clock) from cells)]) as clock from (select distinct event_type from cells))", select="select a.event_type, a.clock::bigint as clock, coalesce(value, -1)::bigint as value from asked a left join cells c on c.event_type = a.event_type and c.clock = a.clock"))
def history_cell(spark, sf_dir):
    cells = history_hourly(spark, sf_dir)
    asked = cells.select("event_type").distinct().crossJoin(F.broadcast(cells.agg(F.array(F.lit(0).cast("long"), F.min("clock")).alias("c")))).select("event_type", F.explode("c").alias("clock"))
    return history.cell(cells, "event_type", asked)


def _user_series(spark, sf_dir):
    cells = history.counted(timed_events(spark, sf_dir), 3600, "user_id")
    return history.dense(cells, 3600, "user_id")


@query(
    sql.chain(
        sql.USER_DENSE, sql.SIGNS,
        select="""select m.user_id, clock, value, case when before >= 1 and value < mean - dev * 2 then 'disappearance' else 'spike' end as kind
from marked m join periods p on p.user_id = m.user_id
where not periodic and before is not null and ((before >= 1 and value < mean - dev * 2) or value > mean + dev * 2)""",
    )
)
def anomaly(spark, sf_dir):
    return history.anomalies(_user_series(spark, sf_dir), "user_id", 2.0, 1.0)


@query(sql.chain(sql.USER_DENSE, sql.SIGNS, select="select user_id, periodic from periods"))
def periodicity(spark, sf_dir):
    return history.periodic(_user_series(spark, sf_dir), "user_id", 2.0)


def _stream(spark, sf_dir, name, run):
    """The result of a streaming query over a table that is read once, to its end."""
    path = f"{sf_dir}/{name}.parquet"
    frame = spark.read.parquet(path)
    source = spark.readStream.schema(frame.schema).option("pathGlobFilter", f"{name}.parquet" if not path.startswith("viewfs") else "*").parquet(sf_dir)
    at = folder(spark, f"stream-{name}")
    found = run(source)
    write = lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/result")
    found.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/position").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{at}/result")


@query(f"select event_type, {sql.EVENT_HOUR} as clock, count(*) as value from events group by all")
def streaming_history(spark, sf_dir):
    found = _stream(spark, sf_dir, "events", lambda s: feeds.streaming_counts(s.withColumn("time", F.col("ts").cast("timestamp")), "time", "1 hour", "1 hour", "event_type"))
    return found.select("event_type", F.unix_timestamp("window.start").alias("clock"), "value")


# -- sessions ----------------------------------------------------------------------------------------------


def _event_records(spark, sf_dir):
    """Events as session records: the key is the user, a purchase begins a segment."""
    e = timed_events(spark, sf_dir)
    return e.select(F.col("user_id").cast("string").alias("pattern_key"), F.struct("ts", "event_id").alias("ord"), "epoch", (F.col("event_type") == "signup").alias("matched"), F.col("event_type").alias("group_id"))


_SEGMENTS = """seg as (select user_id::varchar as key, ts, event_id, event_type, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as segment from events),
parts as (select key, segment, string_agg(event_type, ' ' order by ts, event_id) as pattern, floor(epoch(min(ts)))::bigint as start from seg group by all),
found as (select pattern, key, arg_min(start, segment) as start_epoch, count(*) as cnt from parts group by all)"""


@query(sql.chain(_SEGMENTS, select="select pattern, key, start_epoch, cnt from found"))
def patterns_first_match(spark, sf_dir):
    return patterns.first_match(_event_records(spark, sf_dir))


@query(sql.chain(_SEGMENTS, "totals as (select pattern, sum(cnt)::bigint as total from found group by pattern having sum(cnt) >= 3)", select="select found.pattern, key, start_epoch, cnt, total from found join totals on totals.pattern = found.pattern"))
def pattern_ranking(spark, sf_dir):
    return patterns.ranked(patterns_first_match(spark, sf_dir), 3)


@query(
    """with whole as (select conv_id, string_agg(role, ' ' order by turn, text) as pattern, min(turn) as start, 'first:' || arg_min(role, turn) as relation from conversations group by conv_id)
select pattern, relation as key, min(start) as start_epoch, count(*) as cnt from whole group by all"""
)
def patterns_relations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.col("conv_id").isNotNull())
    records = c.select(F.col("conv_id").cast("string").alias("pattern_key"), F.struct("turn", "text").alias("ord"), F.col("turn").alias("epoch"), F.lit(True).alias("matched"), F.col("role").alias("group_id"))
    tags = c.groupBy(F.col("conv_id").cast("string").alias("pattern_key")).agg(F.lit("first").alias("name"), F.min_by("role", "turn").alias("value"))
    return patterns.relations(records, tags)


_KEYED = r"(?P<type>\w+) user=(?P<patternKey>\d+)"


@query(sql.chain(sql.EVENT_LINES, select="select event_id, regexp_extract(line, '(\\w+) user=(\\d+)', 2) as pattern_key, regexp_extract(line, '(\\w+) user=(\\d+)', 1) as type from lines"))
def pattern_key_extract(spark, sf_dir):
    rows = patterns.keys(event_messages(spark, sf_dir), (_KEYED,))
    return rows.select("event_id", "pattern_key", F.col("tags")["type"].alias("type"))


@query(sql.chain(sql.EVENT_LINES, select="select regexp_extract(line, 'user=(\\d+)', 1) as pattern_key, 'type' as name, arg_max(regexp_extract(line, '(\\w+) user=', 1), (ts, event_id)) as value from lines group by 1"))
def pattern_tags(spark, sf_dir):
    return patterns.key_tags(patterns.keys(event_messages(spark, sf_dir), (_KEYED,)))


@query(
    """with first as (select user_id::varchar as key, min(event_id) as since from events where event_type = 'signup' group by 1)
select e.event_id, key as pattern_key, event_type = 'signup' as matched from events e join first on key = e.user_id::varchar and e.event_id >= since"""
)
def key_association(spark, sf_dir):
    e = timed_events(spark, sf_dir)
    key = F.col("user_id").cast("string")
    rows = e.select(F.col("event_id").alias("ord"), "epoch", F.array(F.col("event_type"), key).alias("tokens"), F.lit(0).alias("group_id"), F.when(F.col("event_type") == "signup", key).alias("pattern_key"))
    found = patterns.associated(rows)
    return found.select(F.col("ord").alias("event_id"), "pattern_key", "matched")


@query(sql.chain(sql.EVENT_LINES, select="select event_type, arg_max(line, (lines.ts, lines.event_id)) as last_message from lines join events using (event_id) group by event_type"))
def last_message(spark, sf_dir):
    rows = event_lines(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    return rows.groupBy("event_type").agg(F.max_by("line", "ord").alias("last_message"))


@query("select event_type, floor(epoch(min(ts)))::bigint as created, floor(epoch(max(ts)))::bigint as updated, count(*) as count from events group by event_type")
def first_last_seen(spark, sf_dir):
    return timed_events(spark, sf_dir).groupBy("event_type").agg(F.min("epoch").alias("created"), F.max("epoch").alias("updated"), F.count("*").alias("count"))


_SEARCHED = ("idiot", "license", "the", "thing", "4", "4.0", "by-nc", "cc by", "u")


@query(f"select doc_id as id, w as word from documents, (select unnest({list(_SEARCHED)}) as w) where regexp_matches(lower(text), '(^|[^a-z])' || regexp_escape(w) || '($|[^a-z])')")
def multi_word_match(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in _SEARCHED], "word string")
    return matching.whole_words(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), words)


@query(f"select doc_id as id, w as word from documents, (select unnest({list(_SEARCHED)}) as w) where contains(text, w)")
def substring_match(spark, sf_dir):
    return matching.substrings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), list(_SEARCHED))


# -- tables ------------------------------------------------------------------------------------------------


@query("select count(*) as count, round(sum(o_totalprice), 2) as sum, max(o_totalprice) as max, min(o_totalprice) as min from orders where o_orderstatus = 'F'")
def table_aggregates(spark, sf_dir):
    return tables.aggregated(table(spark, sf_dir, "orders"), "o_totalprice", F.col("o_orderstatus") == "F").withColumn("sum", F.round("sum", 2))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem order by l_quantity::int desc, l_orderkey::bigint desc, l_linenumber::int desc limit 50")
def typed_order_by(spark, sf_dir):
    rows = tables.projected(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"])
    return tables.ordered(rows, [("l_quantity", "int"), ("l_orderkey", "long"), ("l_linenumber", "int")], True).limit(50)


@query("select c_custkey, c_name, c_acctbal from customer where c_custkey = 7 limit 1")
def select_first_row(spark, sf_dir):
    columns = ["c_custkey", "c_name", "c_acctbal"]
    row = tables.first_row(table(spark, sf_dir, "customer"), F.col("c_custkey") == 7, columns)
    return spark.createDataFrame([tuple(row)], table(spark, sf_dir, "customer").select(*columns).schema)


@query("select s_suppkey, case when s_acctbal < 0 then 'debtor' else s_name end as s_name, s_nationkey, case when s_acctbal < 0 then 0 else s_acctbal end as s_acctbal from supplier")
def update_rows(spark, sf_dir):
    return tables.updated(table(spark, sf_dir, "supplier"), F.col("s_acctbal") < 0, {"s_name": "debtor", "s_acctbal": 0.0})


@query("select * from supplier where not coalesce(s_acctbal < 0, false)")
def delete_rows(spark, sf_dir):
    return tables.deleted(table(spark, sf_dir, "supplier"), F.col("s_acctbal") < 0)


@query(
    """with changes as (select s_suppkey + 5 as s_suppkey, 'new' as s_name from supplier where s_suppkey <= 10)
select coalesce(s.s_suppkey, c.s_suppkey) as s_suppkey, coalesce(c.s_name, s.s_name) as s_name, s_nationkey, s_acctbal from supplier s full join changes c on c.s_suppkey = s.s_suppkey"""
)
def upsert_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return tables.upserted(s, s.where("s_suppkey <= 10").select((F.col("s_suppkey") + 5).alias("s_suppkey"), F.lit("new").alias("s_name")), ["s_suppkey"])


@query("select o_orderkey, round((o_totalprice - min(o_totalprice) over ()) / (max(o_totalprice) over () - min(o_totalprice) over ()), 9) as normalised from orders")
def normalize_minmax(spark, sf_dir):
    return tables.normalised(table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", F.round("normalised", 9).alias("normalised"))


@query("select o_orderpriority, round(avg(o_totalprice), 4) as mean, round(stddev_pop(o_totalprice), 4) as std from orders group by o_orderpriority")
def mean_std(spark, sf_dir):
    return tables.mean_and_deviation(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority").select("o_orderpriority", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("select distinct p_brand from part")
def distinct_strings(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand").distinct()


@query("select p_partkey, row_number() over (partition by p_brand order by p_retailprice, p_partkey) - 1 as place from part")
def arg_sort(spark, sf_dir):
    return tables.numbered(table(spark, sf_dir, "part").withColumn("key", F.struct("p_retailprice", "p_partkey")), "key", "p_brand").select("p_partkey", F.col("place").cast("long").alias("place"))


# -- blocks ------------------------------------------------------------------------------------------------

_DAYS = f"days as (select *, {sql.EVENT_DAY} as bucket from events), blocks as (select distinct bucket, bucket // 86400 as block from days)"


def _event_blocks(spark, sf_dir):
    e = timed_events(spark, sf_dir).withColumn("bucket", scalars.time_bucket(F.col("epoch"), 86400))
    return e.withColumn("block", store.block_of(F.col("bucket"), 86400))


@query(f"with {_DAYS} select bucket // 86400 as block, count(*) as rows, (dense_rank() over (order by bucket // 86400) - 1) % 3 as block_no from days group by bucket")
def block_assign(spark, sf_dir):
    counts = _event_blocks(spark, sf_dir).groupBy("block").agg(F.count("*").alias("rows"))
    numbered = counts.withColumn("last_index", F.dense_rank().over(Window.orderBy("block")) - 1)  # a row for a day
    return store.ring(numbered, 3).select("block", "rows", F.col("block_no").cast("long").alias("block_no"))


@query(f"with {_DAYS} select block, count(*) as rows from days join blocks using (bucket) where bucket >= (select max(bucket) from days) - 3 * 86400 + 1 group by block")
def retention(spark, sf_dir):
    blocks = _event_blocks(spark, sf_dir).groupBy("block").agg(F.count("*").alias("rows"), F.max("bucket").alias("last_epoch"))
    return store.kept(blocks, 3, 86400).select("block", "rows")


@query(f"with {_DAYS}, last as (select max(block) as l from blocks) select block from blocks, last where block > l - 4")
def ring_overwrite(spark, sf_dir):
    return store.surviving(_event_blocks(spark, sf_dir).select(F.col("block").alias("last_index")).distinct(), 4).select(F.col("last_index").alias("block"))


@query(f"with {_DAYS} select event_id, bucket // 86400 as block from days where (bucket // 86400) < (select max(block) from blocks)")
def completed_blocks(spark, sf_dir):
    e = _event_blocks(spark, sf_dir)
    status = e.select("block").distinct().crossJoin(F.broadcast(e.agg(F.max("block").alias("last")))).select("block", (F.col("block") < F.col("last")).alias("completed"))
    return store.completed(e.select("event_id", "block"), status)


@query("select event_type, count(*) as count from (select * from events where user_id % 2 = 0 union all select * from events where user_id % 2 = 1) group by event_type")
def union_blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("user_id % 2 = 0").unionByName(e.where("user_id % 2 = 1")).groupBy("event_type").agg(F.count("*").alias("count"))


@query(
    sql.chain(
        sql.EVENT_LINES,
        sql.token_table("{t}", f"(select event_id, floor(epoch(ts))::bigint // 86400 as block, {sql.NORMAL.format('substr(line, 21)')} as msg from lines)", "event_id, block"),
        select="select block, term, count(*) as df from (select block, id, unnest(list_distinct(t)) as term from tok) group by all",
    )
)
def block_term_counts(spark, sf_dir):
    rows = event_messages(spark, sf_dir).withColumns({"tokens": tok.tokens(F.col("msg"), PLAIN), "block": store.block_of(F.col("bucket"), 86400)})
    return terms.term_counts(rows.groupBy("block", "tokens").agg(F.count("*").alias("lines")), "block")


@query("select doc_id as source, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))::bigint as lines from documents group by doc_id having sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) > 0")
def line_counts(spark, sf_dir):
    return document_lines(table(spark, sf_dir, "documents")).groupBy(F.col("doc_id").alias("source")).agg(F.count("*").alias("lines"))


# -- scalars -----------------------------------------------------------------------------------------------


@query(
    """select l_orderkey, l_linenumber, sign(x) * floor(abs(x) * 10 + 0.5::double) / 10 as rounded, (sign(x * 10) * floor(abs(x * 10)) + case when x >= 0 then 1 else -1 end) / 10 as up, sign(x) * floor(abs(x) * 10) / 10 as down
from (select *, l_extendedprice - 30000::double as x from lineitem)"""
)
def round_family(spark, sf_dir):
    x = F.col("l_extendedprice") - 30000.0
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.round_half_up(x, 1).alias("rounded"), scalars.round_up(x, 1).alias("up"), scalars.round_down(x, 1).alias("down"))


@query(
    """select o_orderkey, ltrim(array_to_string(list_transform(generate_series(7, 0, -1), lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((o_orderkey // (36 ** k)::bigint) % 36)::int + 1, 1)), ''), '0') as b36, o_orderkey as back
from orders where o_orderkey > 0"""
)
def base36(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderkey > 0").select("o_orderkey", scalars.to_base36(F.col("o_orderkey")).alias("b36"))
    return rows.withColumn("back", scalars.from_base36(F.col("b36")))


@query("select p_partkey, (ceil(p_partkey / 7.0) * 7)::bigint as next from part")
def next_divisible(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.next_divisible(F.col("p_partkey"), F.lit(7)).alias("next"))


@query("select p_partkey, coalesce(try_cast(p_name as bigint), 0) as of_name, coalesce(try_cast(p_size::varchar as bigint), 0) as of_size, coalesce(case when regexp_matches(right(p_brand, 2), '^[0-9]+$') then right(p_brand, 2)::bigint end, 0) as of_brand from part")
def to_int_or_zero(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.to_int_or_zero(F.col("p_name")).alias("of_name"), scalars.to_int_or_zero(F.col("p_size").cast("string")).alias("of_size"), scalars.to_int_or_zero(F.expr("right(p_brand, 2)")).alias("of_brand"))


_NUMBERS = """(select p_name as s from part union select p_size::varchar from part union select l_quantity::varchar from lineitem union select '0' || p_size from part union select '.' || p_size || 'e3' from part
union select unnest(['', '1.', '-3', '1.2.3']))"""


@query(f"select s, regexp_matches(s, '^(0|[1-9][0-9]*)$') as is_int, regexp_matches(s, '^\\d+(\\.\\d+)?$') as is_real, try_cast(s as double) is not null as is_numeric from {_NUMBERS}")
def number_checks(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name", F.col("p_size").cast("string").alias("p_size"))
    rows = part.select(F.explode(F.array("p_name", "p_size", F.concat(F.lit("0"), "p_size"), F.concat(F.lit("."), "p_size", F.lit("e3")))).alias("s"))
    rows = rows.union(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("string")))
    rows = rows.union(spark.createDataFrame([(s,) for s in ("", "1.", "-3", "1.2.3")], "s string")).distinct()
    return rows.select("s", scalars.is_int(F.col("s")).alias("is_int"), scalars.is_real_number(F.col("s")).alias("is_real"), scalars.is_numeric(F.col("s")).alias("is_numeric"))


@query("select event_id, floor(epoch(ts))::bigint + 3 * 86400 as later, floor(epoch(ts))::bigint - 2 * 86400 as earlier, strftime(ts, '%Y-%m-%d %H:%M:%S') as shown, (floor(epoch(ts))::bigint // 3600) * 3600 as bucket from events")
def epoch_helpers(spark, sf_dir):
    e = F.col("epoch")
    return timed_events(spark, sf_dir).select("event_id", scalars.add_days(e, 3).alias("later"), scalars.days_before(2, e).alias("earlier"), scalars.epoch_to_string(e).alias("shown"), scalars.time_bucket(e, 3600).alias("bucket"))


@query("select event_id, epoch(date_trunc('second', ts))::bigint as epoch from events")
def parse_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss").alias("s"))
    return e.select("event_id", scalars.parse_date(F.concat("s", F.lit(" +0900")), "02/Jan/2006:15:04:05 -0700").alias("epoch"))


# -- clusters ----------------------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("vector"))


@query(sql.chain(sql.VECTORS, sql.CENTRES, select="select cluster, round(sum(x * k), 4) as weighted, count(*) as n from c group by cluster"))
def centroids(spark, sf_dir):
    c = clusters.centroids(_vectors(spark, sf_dir))
    weighted = F.aggregate(F.transform("centroid", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return c.select("cluster", F.round(weighted, 4).alias("weighted"), F.size("centroid").cast("long").alias("n"))


@query(sql.chain(sql.VECTORS, sql.CENTRES, "d as (select id, c.cluster, sqrt(sum((v.x - c.x) * (v.x - c.x))) as d from v join c on c.k = v.k group by all)", select="select id, arg_min(cluster, (round(d, 9), cluster)) as cluster, round(min(d), 4) as distance from d group by id"))
def assign_clusters(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return clusters.assigned(v, clusters.centroids(v)).select("id", "cluster", F.round("distance", 4).alias("distance"))


@query(sql.chain(sql.VECTORS, sql.CENTRES, sql.OWN, "m as (select *, avg(d) over (partition by cluster) as a, stddev_pop(d) over (partition by cluster) as s from own)", select="select id, cluster from m where abs(d - a) <= s * 1.5"))
def cluster_outliers(spark, sf_dir):
    return clusters.without_outliers(_vectors(spark, sf_dir), 1.5).select("id", "cluster")


@query(sql.chain(sql.VECTORS, sql.CENTRES, sql.OWN, select="select cluster, count(*) as size, round(sum(d) / greatest(count(*) - 1, 1), 4) as intra from own group by cluster"))
def cluster_spreads(spark, sf_dir):
    return clusters.spreads(_vectors(spark, sf_dir)).withColumn("intra", F.round("intra", 4))


@query(sql.chain(sql.VECTORS, sql.CENTRES, select="select p.cluster as a, q.cluster as b, round(sqrt(sum((p.x - q.x) * (p.x - q.x))), 4) as inter from c p join c q on p.k = q.k and p.cluster < q.cluster group by all"))
def cluster_separations(spark, sf_dir):
    return clusters.separations(_vectors(spark, sf_dir)).withColumn("inter", F.round("inter", 4))


@query(sql.chain(sql.VECTORS, sql.CENTRES, sql.OWN, "s as (select cluster, count(*) as n, sum(d) / greatest(count(*) - 1, 1) as i from own group by cluster order by n desc, cluster limit 3)", select="select round(avg(i), 4) as compactness from s"))
def compactness(spark, sf_dir):
    return clusters.compactness(_vectors(spark, sf_dir), 3).withColumn("compactness", F.round("compactness", 4))


@query(
    """with pairs as (select a.vec_id as id, a.label as cluster, b.label as other, avg(list_distance(a.embedding::double[], b.embedding::double[])) as d from embeddings a join embeddings b on a.vec_id <> b.vec_id group by all),
s as (select id, cluster, max(case when other = cluster then d end) as a, min(case when other <> cluster then d end) as b from pairs group by all)
select id, cluster, round(case when a is null or b is null then 0 else (b - a) / greatest(a, b) end, 4) as silhouette from s"""
)
def silhouette(spark, sf_dir):
    return clusters.pair_silhouettes(_vectors(spark, sf_dir)).withColumn("silhouette", F.round("silhouette", 4))
