import random

import pytest
from pyspark.sql import functions as F
from samples import FIRST, FORMAT, LAYOUT, hourly

from siltstone.config import Config
from siltstone.operators import parsing, templates, terms
from siltstone.operators.tokens import tokens

BASE = Config(log_format=FORMAT, timestamp_layout=LAYOUT, min_match_rate=0.6, term_count_border=10, separators=" ,;[]<>{}=|:&?/+.!@")


def lines(spark, texts):
    return spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "ord long, line string, file_epoch long")


def found(spark, config, texts, search=(), exclude=()):
    rows = templates.in_range(templates.groups(parsing.parsed(lines(spark, texts), config), config), search=search, exclude=exclude)
    return {r["display"]: r["count"] for r in rows.collect()}


# The display strings and counts that these settings must give for the sample lines, here and in
# the tests of keywords, regexes, filters and numbers below.


def test_filters_choose_the_lines(spark):
    config = BASE.with_values({"search_regex": ["grpa20|grpb20"], "exclude_regex": ["grpa10", "grpe10"]})
    got = found(spark, config, hourly(FIRST))
    assert len(got) == 3 and got["Com1, grpb10 Com2 * grpa50 * <coM3> * grpa20 *"] == 10


def test_keywords_stay_and_ignored_words_go(spark):
    config = BASE.with_values({"keywords": ["grpa10"], "ignorewords": ["grpa20"], "term_count_border": 19, "min_match_rate": 0.5})
    got = found(spark, config, hourly(FIRST))
    assert got["Com1, * Com2 * grpa50 * <coM3> * grpb20 *"] == 20
    assert got["Com1, grpa10 Com2 * grpa50 * <coM3> * * *"] == 10 and len(got) == 4


def test_key_and_ignore_regexes(spark):
    config = BASE.with_values({"key_regexes": [".*10$"], "ignore_regexes": [".*50$"], "term_count_border": 19, "min_match_rate": 0.5})
    got = found(spark, config, hourly(FIRST))
    assert got["Com1, grpb10 Com2 * * * <coM3> * grpa20 *"] == 10
    assert got["Com1, grpa10 Com2 (uniq)0010 * (uniq)0110 <coM3> (uniq)0210 grpa20 (uniq)0310"] == 1 and len(got) == 6


def test_output_filter(spark):
    assert len(found(spark, BASE, hourly(FIRST), ("grpa20",))) == 2
    assert len(found(spark, BASE, hourly(FIRST), ("grpa20",), ("grpa10",))) == 1


@pytest.mark.parametrize(("ignore", "shown"), [(True, "* Com1, grpf10 Com2 (uniq)* grpb50 (uniq)* <coM3> (uniq)* * grpc20 (uniq)*"), (False, "246 Com1, grpf10 Com2 (uniq)* grpb50 (uniq)* <coM3> (uniq)* 1234 grpc20 (uniq)*")])
def test_numbers(spark, ignore, shown):
    texts = [f"2024-10-03T0{k}:00:00] 246 Com1, grpf10 Com2 (uniq)005{k} grpb50 (uniq)015{k} <coM3> (uniq)025{k} 1234 grpc20 (uniq)035{k}" for k in range(1, 5)]
    config = Config(log_format=FORMAT, timestamp_layout=LAYOUT, min_match_rate=0.6, term_count_border=10, ignore_numbers=ignore)
    assert found(spark, config, texts) == {shown: 4}


def test_without_settings_the_border_is_computed(spark):
    assert len(found(spark, Config(), hourly(FIRST))) == 5


def test_message_formats_and_partial_dates(spark):
    texts = [f"Nov 17 03:22:0{k} gate7 relay[{40 + k}] -- cache emptied <{k} of 9>" for k in range(5)] + ["Nov 17 03:22:06 gate7 relay[46] -- took=12ms verdict=drop port=99"]
    config = Config(
        log_format=r"^(?P<timestamp>\S+ +\d+ [\d:]+) \S+ relay\[\d+\] -- (?P<message>.*)$", timestamp_layout="Jan _2 15:04:05",
        msg_formats=(r"^took=\S+ (?P<message>.*)$", r"^(?P<message>[^<]*\S) <\d+ of \d+>$"), term_count_border=3, min_match_rate=0.6,
    )
    rows = parsing.parsed(lines(spark, texts), config, F.lit("2025-03-01 00:00:00").cast("timestamp"))
    assert {r["msg"] for r in rows.collect()} == {"cache emptied", "verdict=drop port=99"}
    assert {F_year(r["epoch"]) for r in rows.collect()} == {2024}
    top = templates.top(templates.groups(rows, config), 1).first()
    assert (top["display"], top["count"]) == ("cache emptied", 5)


def F_year(epoch):
    import datetime

    return datetime.datetime.fromtimestamp(epoch, datetime.UTC).year


def test_lines_that_do_not_parse(spark):
    texts = ["no timestamp here", "2024-13-99T00:00:00] bad date", "   ", "2024-10-01T00:00:00]   two   words "]
    rows = {r["ord"]: (r["msg"], r["epoch"] > 0, r["bucket"]) for r in parsing.parsed(lines(spark, texts), BASE).collect()}
    assert rows[0] == ("", False, 0) and rows[2] == ("", False, 0)
    assert rows[1] == ("2024-13-99T00:00:00] bad date", False, 0)
    assert rows[3] == ("two words", True, 1727740800)
    whole = parsing.parsed(lines(spark, texts[:1]), Config()).first()
    assert (whole["msg"], whole["bucket"]) == ("no timestamp here", -1)


def border_by_a_loop(dfs, rate):
    dfs, total, seen, inside = sorted(dfs, reverse=True), sum(dfs), 0, []
    for d in dfs:
        seen += d
        if float(seen) / float(total) >= rate:
            break
        inside.append(d)
    levels = sorted(set(inside))
    return levels[1] if len(levels) > 1 else levels[0] if levels else max(dfs)


def test_border_equals_a_loop(spark):
    random.seed(5)
    for _ in range(12):
        dfs = [random.choice((1, 1, 1, 2, 3, 5, 9, 40)) for _ in range(random.randint(1, 60))]
        rate = random.choice((0.3, 0.6, 0.9, 0.999))
        table = spark.createDataFrame([(f"t{k}", d) for k, d in enumerate(dfs)], "term string, df long")
        assert terms.border(table, rate).first()["border"] == border_by_a_loop(dfs, rate)
    assert terms.border(table.limit(0), 0.9).first()["border"] == 0


def test_tokens(spark):
    row = spark.createDataFrame([("A 'quoted' end. . x=1;y (z). Ä.",)], "msg string").select(tokens(F.col("msg"), Config()).alias("t")).first()
    assert row["t"] == ["a", "quoted", "end", ".", "x", "1", "y", "z", ".", "ä"]


def test_top_orders_ties_by_score(spark):
    rows = spark.createDataFrame([(1, 5, 2.0), (2, 5, 1.0), (3, 9, 3.0), (4, 5, 1.0)], "group_id long, count long, score double")
    assert [r["group_id"] for r in templates.top(rows, 3).collect()] == [3, 2, 4]
    assert [r["group_id"] for r in templates.top(rows, 0, ascending=True).collect()] == [1, 2, 4, 3]


def test_regrouping_adds_counts(spark):
    config = BASE.with_values({"term_count_border": 20, "min_match_rate": 0.4})
    rows = templates.groups(parsing.parsed(lines(spark, hourly(FIRST)), BASE), BASE)
    merged = {r["template"]: r["count"] for r in templates.regrouped(rows, config).collect()}
    assert sum(merged.values()) == 50 and len(merged) < rows.count()


def test_empty_table(spark):
    rows = parsing.parsed(lines(spark, ["x"]).limit(0), BASE)
    assert templates.groups(rows, BASE).count() == 0 and templates.templates(rows, Config()).count() == 0


def test_a_long_line_is_masked_in_time_that_grows_with_its_length(spark):
    """The line's border is found once a line, not once for each of its tokens."""
    import time

    texts = [" ".join(f"w{(k * 7 + i * (k + 3)) % 9001}" for i in range(6000)) for k in range(40)]
    rows = parsing.parsed(lines(spark, texts), Config())
    templates.templates(rows.limit(1), Config()).collect()
    began = time.time()
    assert sum(r["count"] for r in templates.templates(rows, Config(term_count_border=3)).collect()) == 40
    assert time.time() - began < 12


def test_frequencies_are_the_same_however_many_are_looked_up(spark):
    """dfs of rows against a loop: all terms, some or none looked up; masks, long terms and empty sequences too."""
    from collections import Counter

    random.seed(11)
    words = [f"t{k}" for k in range(40)] + ["*", "x" * 80]
    rows = [[random.choice(words) for _ in range(random.randint(1, 30))] for _ in range(50)] + [["only"], []]
    distinct = templates.by_sequence(spark.createDataFrame([(r,) for r in rows], "tokens array<string>"), F.count("*").alias("lines"))
    counts = terms.term_counts(distinct)
    df = Counter(t for r in rows for t in set(r) if t != "*")
    for most in (0, 5, 30, 1000):
        got = {r["joined"]: r["dfs"] for r in templates.with_dfs(distinct.drop("tokens"), counts, most).collect()}
        assert got == {" ".join(r): [df[t] for t in r] for r in rows}
    assert templates.looked_up(counts, 5)[0].num_rows <= 5 and templates.looked_up(counts, 1000)[1] is None
    few = counts.where(F.length("term") < 9)
    assert templates.looked_up(few, 1000)[1] == 0 and templates.looked_up(few, 1000)[0].num_rows == few.count()
    ones = counts.where("df = 1 or df > 20").where(F.length("term") < 9)
    assert templates.looked_up(ones, ones.where("df > 1").count())[1] == 1


def test_groups_in_parts_are_regrouped_as_whole_ones(spark):
    config = BASE.with_values({"term_count_border": 20, "min_match_rate": 0.4})
    whole = templates.groups(parsing.parsed(lines(spark, hourly(FIRST)), BASE), BASE).select("display", "count", "created", "updated")
    parts = whole.withColumn("count", F.col("count") - 3).unionByName(whole.withColumn("count", F.lit(3).cast("long")))
    found = lambda rows: sorted((r["template"], r["count"]) for r in templates.regrouped(rows, config).collect())
    assert found(parts) == found(whole)


def test_words_between_any_separators(spark):
    row = spark.createDataFrame([("a^b-c]d\\e[f n&&g é  Xy\ttab",)], "msg string")
    words = lambda separators: row.select(tokens(F.col("msg"), Config(separators=separators)).alias("t")).first()["t"]
    assert words("^-]\\[&nX") == ["a", "b", "c", "d", "e", "f", "g", "é", "xy\ttab"]
    assert words("") == ["a^b-c]d\\e[f", "n&&g", "é", "xy\ttab"]
