"""SQL for the catalogue's queries, in DuckDB's dialect: common table expressions, then a query each."""

from __future__ import annotations

from siltstone.config import DEFAULT_SEPARATORS

_SEPS = DEFAULT_SEPARATORS.replace("'", "''")
_BLANK = " " * len(DEFAULT_SEPARATORS)
_CLASS = "".join("\\" + c for c in DEFAULT_SEPARATORS).replace("'", "''")
RATE, MATCH = 0.999, 0.7

NORMAL = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
LINES = f"""lines as (
    select doc_id, i - 1 as ln, {NORMAL.format('l[i]')} as msg
    from (select doc_id, string_split(text, chr(10)) as l from documents), unnest(generate_series(1, len(l))) as t(i) where trim(l[i]) <> ''
)"""


def words(msg: str) -> str:
    return f"list_filter(string_split(translate(lower({msg}), '{_SEPS}', '{_BLANK}'), ' '), lambda x: x <> '')"


def undotted(x: str) -> str:
    return f"case when len({x}) > 1 and right({x}, 1) = '.' then left({x}, len({x}) - 1) else {x} end"


def tokens(msg: str, rule: str = "{t}") -> str:
    """Tokens of a message; rule gives the token from the word x and its undotted form {t}."""
    return f"list_transform({words(msg)}, lambda x: {rule.format(t=undotted('x'))})"


def token_table(rule: str = "{t}", source: str = "lines", key: str = "doc_id, ln") -> str:
    return f"tok as (select row_number() over () as id, * from (select {key}, msg, {tokens('msg', rule)} as t from {source}))"


DF = "df as (select term, count(*) as df from (select id, unnest(list_distinct(t)) as term from tok) where term <> '*' group by term)"
BORDER = f"""hist as (select df, sum(df)::bigint as mass from df group by df),
cut as (select df, coalesce(sum(mass) over (order by df desc rows between unbounded preceding and 1 preceding), 0) as before, sum(mass) over () as total from hist),
inside as (select df from cut where (before + df)::double / total::double < {RATE}::double),
border as (select coalesce((select max(df) from (select df from inside order by df limit 2)), (select max(df) from df), 0)::bigint as border)"""


def masked(keep: str = "false", match: float = MATCH, border: str = "(select border from border)") -> str:
    """Each line's border, and its masked tokens in order; keep: what is never masked as rare."""
    return f"""parts as (select id, len(t) as n, i, t[i] as term from tok, unnest(generate_series(1, len(t))) as u(i)),
known as (select p.*, coalesce(df, 0) as df from parts p left join df on df.term = p.term and p.term <> '*'),
asked as (select id, any_value(n) as n, list(df order by df desc)[greatest(floor(any_value(n) * {match}::double)::int, 1)] as m from known group by id),
edge as (select id, least({border}, case when m > 0 then m else {border} end) as line_border from asked),
masked as (select k.id, list(case when k.term = '*' or (not ({keep}) and k.df < e.line_border) then '*' else k.term end order by i) as m, list(k.df order by i) as d from known k join edge e on e.id = k.id group by k.id),
found as (select tok.*, coalesce(array_to_string(m, ' '), '') as template, m, d from tok left join masked on masked.id = tok.id)"""


def chain(*parts: str, select: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + select


COUNTS = "select template, count(*) as count from found group by template"

#: Log lines made of events: time, type, user and properties.
EVENT_LINES = """lines as (
    select event_id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' user=' || user_id || ' ' || coalesce(props, '') as line from events
)"""
EVENT_HOUR = "(floor(epoch(ts))::bigint // 3600) * 3600"
EVENT_DAY = "(floor(epoch(ts))::bigint // 86400) * 86400"
DENSE = f"""cells as (select event_type, {EVENT_HOUR} as clock, count(*) as value from events group by all),
line as (select event_type, unnest(generate_series((select min(clock) from cells), (select max(clock) from cells), 3600)) as clock from (select distinct event_type from cells)),
series as (select l.event_type, l.clock, coalesce(value, 0)::bigint as value from line l left join cells c on c.event_type = l.event_type and c.clock = l.clock)"""
USER_DENSE = DENSE.replace("event_type", "user_id")
SIGNS = """marked as (
    select *, avg(value) over w as mean, stddev_pop(value) over w as dev, lag(value) over (partition by user_id order by clock) as before from series window w as (partition by user_id)
),
signs as (select user_id, list(case when value > mean + dev * 2 then 1 when value < mean - dev * 2 then -1 else 0 end order by clock) as s from marked group by user_id),
periods as (
    select user_id, len(s) // 2 >= 2 and len(list_filter(generate_series(2, greatest(len(s) // 2, 2)), lambda p: s[1:len(s) - p] = s[p + 1:len(s)])) > 0 as periodic from signs
)"""
VECTORS = "v as (select vec_id as id, label as cluster, unnest(embedding)::double as x, unnest(generate_series(1, len(embedding))) as k from embeddings)"
CENTRES = "c as (select cluster, k, avg(x) as x from v group by cluster, k)"
OWN = "own as (select id, v.cluster, sqrt(sum((v.x - c.x) * (v.x - c.x))) as d from v join c on c.cluster = v.cluster and c.k = v.k group by all)"
