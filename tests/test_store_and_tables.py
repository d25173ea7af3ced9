import io
import json

import pytest
from pyspark.sql import functions as F
from samples import FIRST, FORMAT, LAYOUT, SECOND, hourly

from siltstone import cli
from siltstone.config import Config
from siltstone.functions import dialects, scalars
from siltstone.operators import clusters, matching, tables
from siltstone.sources import readers, store
from siltstone.streaming import feeds


def one(spark, column, schema="x double", value=(0.0,)):
    return spark.createDataFrame([value], schema).select(column).first()[0]


def test_store_blocks_and_retention(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "data"), {"t": "block long, name string, count long"})
    rows = spark.createDataFrame([(k // 2, f"n{k}", k) for k in range(8)], "block long, name string, count long")
    s.create("t")
    s.append("t", rows)
    assert s.blocks("t") == [0, 1, 2, 3] and s.read("t").count() == 8 and s.read("t", [1]).count() == 2
    s.overwrite_blocks("t", spark.createDataFrame([(1, "only")], "block long, name string"))
    assert {(r["block"], r["name"], r["count"]) for r in s.read("t", [1]).collect()} == {(1, "only", None)} and s.read("t").count() == 7
    assert s.retain("t", 3) == [0] and s.blocks("t") == [1, 2, 3] and s.tables() == ["t"]
    with pytest.raises(ValueError):
        s.append("t", rows.withColumn("other", F.lit(1)))
    s.drop("t")
    assert not s.exists("t") and s.read("t").count() == 0


def test_ring_and_kept_blocks(spark):
    blocks = spark.createDataFrame([(k, 86400 * k) for k in range(5)], "last_index long, last_epoch long")
    assert [r["block_id"] for r in store.ring(blocks, 3).orderBy("last_index").collect()] == [f"BLK{k % 3:010d}" for k in range(5)]
    assert {r["last_index"] for r in store.surviving(blocks, 3).collect()} == {2, 3, 4}
    assert {r["last_index"] for r in store.kept(blocks, 2, 86400).collect()} == {3, 4} and store.kept(blocks, 0, 1).count() == 5


CONFIG = Config(log_format=FORMAT, timestamp_layout=LAYOUT, min_match_rate=0.6, term_count_border=10)


def test_feeds_accumulate_and_can_be_repeated(spark, tmp_path):
    config = CONFIG.with_values({"data_dir": str(tmp_path / "state")})
    part = lambda texts: spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "ord long, line string, file_epoch long")
    for texts, number in ((hourly(FIRST)[:35], 0), (hourly(FIRST)[35:], 1), (hourly(FIRST)[35:], 1)):
        feeds.feed(part(texts), config, number)
    found = {r["display"]: r["count"] for r in feeds.stored_groups(spark, config).collect()}
    assert sum(found.values()) == 50 and found["Com1, grpa10 Com2 (uniq)* grpa50 (uniq)* <coM3> (uniq)* grpa20 (uniq)*"] == 10
    assert any(v == 5 and "grpd10" not in k for k, v in found.items())  # the mask of the first feed stays
    counts = {r["term"]: r["df"] for r in feeds.stored_terms(spark, config).collect()}
    assert (counts["com1"], counts["grpa10"], counts["grpd10"]) == (50, 10, 10)


def test_stream_of_files_feeds_the_store(spark, tmp_path):
    config = CONFIG.with_values({"data_dir": str(tmp_path / "state")})
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text("\n".join(hourly(FIRST)))
    feeds.stream(spark, str(tmp_path / "logs"), config, str(tmp_path / "position")).awaitTermination()
    (tmp_path / "logs/b.log").write_text("\n".join(hourly(SECOND, "2024-10-03T02:00:00", 51)))
    feeds.stream(spark, str(tmp_path / "logs"), config, str(tmp_path / "position")).awaitTermination()
    assert feeds.stored_groups(spark, config).agg(F.sum("count")).first()[0] == 100


def test_readers(spark, tmp_path):
    import gzip
    import os

    (tmp_path / "x.2.log").write_text("c\nd\n")
    gzip.open(tmp_path / "x.1.log.gz", "wt").write("a\nb\n")
    os.utime(tmp_path / "x.1.log.gz", (1000, 1000))
    os.utime(tmp_path / "x.2.log", (2000, 2000))
    rows = readers.log_lines(spark, str(tmp_path / "x.*"))
    assert [r["line"] for r in rows.orderBy("ord").collect()] == list("abcd")
    assert {r["line"] for r in readers.log_lines(spark, str(tmp_path / "x.*"), (1000, 1)).collect()} == set("bcd")
    assert {r["line"] for r in readers.log_lines(spark, str(tmp_path / "x.*"), (1000, -1)).collect()} == set("cd")
    assert sorted(r["lines"] for r in readers.line_counts(rows).collect()) == [2, 2]
    assert json.loads(feeds.saved_position(rows)) == {"last_file_epoch": 2000, "last_file_row": 2}
    with pytest.raises(FileNotFoundError):
        readers.log_lines(spark, str(tmp_path / "none.*"))
    assert [r["line"] for r in readers.standard_input(spark, io.StringIO("p\nq\n")).orderBy("ord").collect()] == ["p", "q"]
    (tmp_path / "m.json").write_text('[{"metric": "m1", "datapoints": [[1.5, 10], [2, 20]]}, {"metric": "m2", "datapoints": [[3, 10]]}]')
    got = {r["time"]: (r["m1"], r["m2"]) for r in readers.metrics(spark, str(tmp_path / "m.json")).collect()}
    assert got == {10: (1.5, 3.0), 20: (2.0, None)}


def test_tables(spark):
    t = spark.createDataFrame([(1, "a", 5.0), (2, "b", None), (3, None, -1.0)], "id long, name string, v double")
    assert tuple(tables.aggregated(t, "v").first()) == (3, 4.0, 5.0, -1.0) and tuple(tables.aggregated(t, "v", F.col("id") > 9).first()) == (0, 0.0, 0.0, 0.0)
    assert [r["id"] for r in tables.ordered(t, [("v", "double")], True).collect()] == [1, 3, 2]
    assert [r["id"] for r in tables.deleted(t, F.col("v") > 0).orderBy("id").collect()] == [2, 3] and tables.deleted(t).count() == 0
    assert [r["name"] for r in tables.updated(t, F.col("v") > 0, {"name": "z"}).orderBy("id").collect()] == ["z", "b", None]
    up = tables.upserted(t, spark.createDataFrame([(2, "n"), (9, "m")], "id long, name string"), ["id"]).orderBy("id").collect()
    assert [(r["id"], r["name"], r["v"]) for r in up] == [(1, "a", 5.0), (2, "n", None), (3, None, -1.0), (9, "m", None)]
    with pytest.raises(LookupError):
        tables.first_row(t, F.col("id") == 77, ["id"])
    with pytest.raises(KeyError):
        tables.projected(t, ["nope"])
    assert {r["normalised"] for r in tables.normalised(t.withColumn("c", F.lit(4)), "c").collect()} == {0.0}


def test_scalars(spark):
    x = F.col("x")
    assert one(spark, scalars.round_half_up(x, 1), value=(-2.25,)) == -2.3 and one(spark, scalars.round_up(x), value=(2.0,)) == 3.0 and one(spark, scalars.round_down(x), value=(-2.7,)) == -2.0
    assert one(spark, scalars.next_divisible(F.lit(7), F.lit(5))) == 10 and one(spark, scalars.next_divisible(F.lit(7), F.lit(0))) == 7
    assert one(spark, scalars.from_base36(scalars.to_base36(F.lit(123456)))) == 123456
    now = F.lit("2024-03-05 06:07:08").cast("timestamp")
    assert one(spark, scalars.parse_date(F.lit("Nov 17 03:22:09"), "Jan _2 15:04:05", now)) == 1700191329
    assert one(spark, scalars.parse_date(F.lit("4th, 10:00:00.250+0900"), "2th, 15:04:05.000-0700", now)) == 1709546400
    assert one(spark, scalars.timestamp_utc(F.lit("2024-10-01 00:00:05"), "2006-01-02 15:04:05")) == 1727740805
    assert one(spark, scalars.sorted_places(F.array(F.lit(3), F.lit(1), F.lit(2)))) == [1, 2, 0]


def test_dialects():
    assert dialects.java_regex(r"(?P<a>[[:alpha:]]+)(?:x)(y)(?<b>z)") == r"(\p{Alpha}+)(?:x)(y)(z)"
    assert dialects.group_names(r"(\()(?:x)(?P<m>[(])(?<n>z)") == {"m": 2, "n": 3}
    assert dialects.java_layout("2006-01-02T15:04:05")[0] == "yyyy'-'MM'-'dd'T'HH':'mm':'ss"


def test_config():
    text = "dataDir: '{{ HOME_X }}/d'\nsearchRegex:\n  - '{{ KEEP }}'\nminMatchRate: 0\nkeywords: one\nunitSecs: 3600\n"
    c = Config.from_yaml(text, {"HOME_X": "/h"}, out_dir="o")
    assert (c.data_dir, c.search_regex, c.min_match_rate, c.keywords, c.unit_secs, c.out_dir) == ("/h/d", ("{{ KEEP }}",), 0.7, ("one",), 3600, "o")
    assert Config.from_json(c.to_json()) == c
    with pytest.raises(ValueError):
        Config().with_values({"nonsense": 1})


def test_clusters(spark):
    points = [(0, 0, [0.0, 0.0]), (1, 0, [0.0, 2.0]), (2, 1, [10.0, 0.0]), (3, 1, [10.0, 2.0]), (4, 1, [30.0, 1.0])]
    v = spark.createDataFrame(points, "id long, cluster int, vector array<float>")
    c = {r["cluster"]: r["centroid"] for r in clusters.centroids(v).collect()}
    assert c[0] == [0.0, 1.0] and c[1][1] == 1.0
    near = {r["id"]: r["cluster"] for r in clusters.assigned(v, spark.createDataFrame([(5, [0.0, 0.0]), (2, [0.0, 0.0]), (7, [10.0, 1.0])], "cluster int, centroid array<double>")).collect()}
    assert near == {0: 2, 1: 2, 2: 7, 3: 7, 4: 7}
    assert {r["id"] for r in clusters.without_outliers(v, 1.2).collect()} == {0, 1, 2, 3}
    assert len({r["cluster"] for r in clusters.best_kmeans(v, 2, 2, 2).collect()}) == 2
    assert clusters.silhouettes(v).count() == 5 and clusters.pair_silhouettes(v).count() == 5
    scores = lambda tile: {r['id']: round(r['silhouette'], 9) for r in clusters.pair_silhouettes(v, tile).collect()}
    assert scores(1) == scores(256)


def test_silhouettes_of_blocks_equal_sql(spark):
    """Repeated ids, null clusters and vectors, copies far from 0 and blocks of every size, against every pair."""
    import duckdb

    from siltstone.plans import catalogue

    shapes = [(k, k % 3, [1e4 + k % 3 + 0.01 * (k % 7), 0.5 * (k % 5), -1e4]) for k in range(40)]
    shapes += [(3, 1, [1e4, 9.0, -1e4]), (3, 2, [1e4, 2.0, -1e4]), (50, None, [1e4, 1.0, 0.0]), (51, 1, None), (52, 7, [1e4, 3.0, 0.0]), (None, 0, [0.0, 0.0, 0.0])]
    same = [(k, k % 2, [0.1, 0.2, 0.3]) for k in range(6)]
    for rows in (shapes, same, same[:1], same[:0]):
        v = spark.createDataFrame(rows, "id long, cluster int, vector array<float>")
        con = duckdb.connect()
        con.sql("create table embeddings (vec_id bigint, label int, embedding float[])")
        for row in rows:
            con.execute("insert into embeddings values (?, ?, ?)", row)
        want = sorted((repr(r) for r in con.sql(catalogue.oracle_sql()["silhouette"]).fetchall()))
        for tile in (1, 7, 2048):
            got = clusters.pair_silhouettes(v, tile).withColumn("silhouette", F.round("silhouette", 4)).collect()
            assert sorted(repr(tuple(r)) for r in got) == want
    with pytest.raises(Exception, match="other lengths"):
        clusters.pair_silhouettes(spark.createDataFrame([(1, 0, [1.0]), (2, 0, [1.0, 2.0])], "id long, cluster int, vector array<double>")).collect()


def test_silhouettes_of_many_rows_are_soon_there(spark):
    """Six thousand rows, 36 million pairs: distances by matrix products, not by an expression for each pair."""
    import time

    import numpy as np

    x, label = np.random.default_rng(3).normal(size=(6000, 64)), np.arange(6000) % 5
    v = spark.createDataFrame([(k, int(label[k]), x[k].tolist()) for k in range(6000)], "id long, cluster int, vector array<double>").localCheckpoint()
    began = time.time()
    got = {r["id"]: r["silhouette"] for r in clusters.pair_silhouettes(v).collect()}
    assert time.time() - began < 25 and len(got) == 6000
    for k in (0, 17, 5999):
        d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        a, b = d[label == label[k]].sum() / 1199, min(d[label == c].mean() for c in range(5) if c != label[k])
        assert abs(got[k] - (b - a) / max(a, b)) < 1e-9


def test_matching(spark):
    texts = spark.createDataFrame([(1, "the Cat catcar car"), (2, "cat-a 4car car4 x")], "id long, text string")
    words = spark.createDataFrame([("cat",), ("car",), ("at",), ("r4",), ("4",), ("cat-A",), ("t c",)], "word string")
    found = {(r["id"], r["word"]) for r in matching.whole_words(texts, words).collect()}
    assert found == {(1, "cat"), (1, "car"), (2, "cat"), (2, "car"), (2, "cat-a")}  # only letters a-z are boundaries; a 4 stands beside one both times
    legs = matching.whole_words(spark.createDataFrame([(1, "leg p12 rings 7")], "id long, text string"), spark.createDataFrame([("p1",), ("7",), ("2",), ("p",)], "word string"))
    assert {r["word"] for r in legs.collect()} == {"p1", "7", "2", "p"}
    assert {(r["id"], r["word"]) for r in matching.substrings(texts, ["at", "tc"]).collect()} == {(1, "at"), (1, "tc"), (2, "at")}


def test_command_line(spark, tmp_path):
    (tmp_path / "x.log").write_text("\n".join(hourly(FIRST)))
    (tmp_path / "c.yml").write_text(f"logPath: '{tmp_path}/x.log'\nlogFormat: '{FORMAT}'\ntimestampLayout: '{LAYOUT}'\ntermCountBorder: 10\nminMatchRate: 0.6\noutDir: '{tmp_path}/out'\ndataDir: '{tmp_path}/data'\n")
    args = ["-c", str(tmp_path / "c.yml")]
    assert len(cli.main(["groups", *args, "-N", "3"], spark)) == 3
    assert len(cli.main(["groups", *args, "-s", "grpa20"], spark)) == 2
    assert len(cli.main(["history", *args], spark)) == 7
    assert any("grpa10" in x for x in cli.main(["test", *args, "--line", hourly(FIRST)[0]], spark))
    cli.main(["feed", *args], spark)
    cli.main(["clean", *args], spark)
    assert not (tmp_path / "data").exists()
