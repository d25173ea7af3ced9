"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import containment, html_text, language, licenses, near_dups, packing, quality_classifier, quality_rules, toxicity, warc

VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), vocabulary())


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rated(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_duplicates": NEAR_DUPLICATES, "op6_quality_rules": quality_rules_sql(), "op7_decontamination": DECONTAMINATION, "op9_warc": WARC}


_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SETS = """{name} as (
    select id, array_to_string(list_slice(w, i, i + 4), ' ') as s
    from (select {id} as id, """ + _WORDS.format(text="coalesce(text, '')") + """ as w from {table}), unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) as t(i)
    group by all
)"""

NEAR_DUPLICATES = (
    "with recursive "
    + _SETS.format(name="sets", id="doc_id", table="documents")
    + """,
sizes as (select id, count(*) as n from sets group by id),
links as (
    select a, b from (select x.id as a, y.id as b, count(*) as common from sets x join sets y on x.s = y.s and x.id <> y.id group by all)
    join sizes p on p.id = a join sizes q on q.id = b
    where 100 * common >= 75 * (p.n + q.n - common)
),
reach as (
    select a, b from links
    union
    select r.a, l.b from reach r join links l on r.b = l.a
)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id, least(d.doc_id, coalesce(low, d.doc_id)) = d.doc_id as kept
from documents d left join sizes on id = d.doc_id left join (select a, min(b) as low from reach group by a) on a = d.doc_id"""
)

DECONTAMINATION = (
    "with "
    + _SETS.format(name="sets", id="doc_id", table="documents")
    + ", "
    + _SETS.format(name="items", id="item_id", table="benchmark")
    + """,
sizes as (select id, count(*) as n from items group by id)
select doc_id, item_id, n_shared, n as n_item
from (select d.id as doc_id, i.id as item_id, count(*) as n_shared from sets d join items i on d.s = i.s group by all) join sizes on id = item_id
where 100 * n_shared >= 75 * n"""
)


#: SHA-1 as hexadecimal digits, in groups of five bits; recursion over the 32 letters is plain arithmetic.
WARC = """with p as (select page_id, coalesce(html, '') as t, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages),
bits as (select page_id, t, n, h, list_transform(generate_series(0, 31), lambda k: (('0x' || substr(h || '0000', (k * 5) // 4 + 1, 3))::int >> (7 - (k * 5) % 4)) % 32) as b from p),
d as (select page_id, n, h, array_to_string(list_transform(b, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1)), '') as digest, max(page_id) over (partition by h) as top from bits)
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id = top then null else top end as refers_to from d"""


def quality_rules_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for line in quality_rules.STOP_WORDS.values() for w in line.split()}))
    verdict = " and ".join(f"({ratio}) {sign} {bound}::double" for _, ratio, least, most in quality_rules.THRESHOLDS for sign, bound in ((">=", least), ("<=", most)) if bound is not None)
    return rf"""with base as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
    from documents
),
windows as (select doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') as s from base, unnest(generate_series(1, len(w) - 7)) as u(i)),
repeated as (select doc_id, i from windows qualify count(*) over (partition by doc_id, s) > 1),
covered as (select doc_id, count(distinct i + k) as n from repeated, unnest(generate_series(0, 7)) as u(k) group by doc_id),
counts as (
    select b.doc_id, len(w)::bigint as n_words, len(array_to_string(w, ''))::bigint as word_chars,
        (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
        coalesce(n, 0)::bigint as n_repeat_words, len(l) as n_lines, len(t) - len(replace(t, '!', '')) as n_shouts,
        len(list_filter(w, lambda x: lower(x) in ({stop}))) as n_stop_words
    from base b left join covered c on c.doc_id = b.doc_id
),
rated as (select *, {quality_rules.BASE_FAILED} as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({verdict}, false) as kept from rated"""
