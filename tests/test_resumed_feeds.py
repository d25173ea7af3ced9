"""The feed command: goes on where it ended, and keeps blocks as the settings say."""

import os

from pyspark.sql import functions as F
from samples import FIRST, FORMAT, LAYOUT, hourly

from siltstone import cli
from siltstone.config import Config
from siltstone.streaming import feeds


def test_feeds_go_on_over_grown_rotated_and_deleted_logs(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    config = Config(log_path=f"{logs}/*", data_dir=str(tmp_path / "data"), log_format=FORMAT, timestamp_layout=LAYOUT, min_match_rate=0.6, term_count_border=10)
    (tmp_path / "c.yml").write_text(f"logPath: '{logs}/*'\nlogFormat: '{FORMAT}'\ntimestampLayout: '{LAYOUT}'\ntermCountBorder: 10\nminMatchRate: 0.6\ndataDir: '{tmp_path}/data'\n")
    texts = hourly(FIRST)

    def fed():
        cli.main(["feed", "-c", str(tmp_path / "c.yml")], spark)
        terms = {r["term"]: r["df"] for r in feeds.stored_terms(spark, config).collect()}
        return feeds.stored_groups(spark, config).agg(F.sum("count")).first()[0], terms["com1"]

    (logs / "a.log").write_text("\n".join(texts[:10]) + "\n")
    (logs / "b.log").write_text("\n".join(texts[10:20]) + "\n")
    assert fed() == (20, 20) and fed() == (20, 20)
    with open(logs / "a.log", "a") as out:  # both grow
        out.write("\n".join(texts[20:23]) + "\n")
    with open(logs / "b.log", "a") as out:
        out.write("\n".join(texts[23:25]) + "\n")
    assert fed() == (25, 25)
    os.rename(logs / "a.log", logs / "a.log.1")
    (logs / "a.log").write_text("\n".join(texts[25:40]) + "\n")
    os.remove(logs / "b.log")
    assert fed() == (40, 40)


def test_feeds_drop_blocks_past_the_settings(spark, tmp_path):
    part = lambda a, b: spark.createDataFrame([(k, t, 0) for k, t in enumerate([*hourly(FIRST)[a:b], "no time"])], "ord long, line string, file_epoch long")
    for name, values, want in (("p", {"keep_period": 2}, 26 + 2), ("m", {"max_blocks": 1}, 2 + 2)):  # 24 + 24 + 2 hours of three days
        config = Config(data_dir=str(tmp_path / name), log_format=FORMAT, timestamp_layout=LAYOUT, min_match_rate=0.6, term_count_border=10).with_values(values)
        feeds.feed(part(0, 30), config, 0)
        feeds.feed(part(30, 50), config, 1)
        assert feeds.stored_groups(spark, config).agg(F.sum("count")).first()[0] == want
        assert {r["term"]: r["df"] for r in feeds.stored_terms(spark, config).collect()}["com1"] == want - 2


def test_reports_show_what_the_store_holds(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    config = Config(log_path=f"{logs}/*", data_dir=str(tmp_path / "data"), log_format=FORMAT, timestamp_layout=LAYOUT, min_match_rate=0.6, term_count_border=10)
    (tmp_path / "c.yml").write_text(f"logPath: '{logs}/*'\nlogFormat: '{FORMAT}'\ntimestampLayout: '{LAYOUT}'\ntermCountBorder: 10\nminMatchRate: 0.6\ndataDir: '{tmp_path}/data'\n")
    texts = hourly(FIRST)
    (logs / "a.log").write_text("\n".join(texts[:20]) + "\n")
    command = lambda *a: cli.main([*a, "-c", str(tmp_path / "c.yml")], spark)
    assert sum(int(line.split()[0]) for line in command("groups", "-N", "0")) == 20
    os.remove(logs / "a.log")  # rotated away: the store still has it
    (logs / "b.log").write_text("\n".join(texts[20:]) + "\nno time\n")
    assert sum(int(line.split()[0]) for line in command("groups", "-N", "0")) == 51
    cells = [line.split() for line in command("history", "-N", "0")]
    days = {clock: sum(int(v) for _, c, v in cells if c == clock) for _, clock, _ in cells}
    assert sorted(days.values()) == [2, 24, 24]
    alone = feeds.scored_groups(spark, config).select("score").collect()
    assert all(r["score"] >= 0 for r in alone) and any(r["score"] > 1 for r in alone)


def test_sessions_go_on_over_feeds(spark, tmp_path):
    config = Config(data_dir=str(tmp_path / "data"), log_format=r"^(?P<timestamp>\S+) (?P<message>.+)$", timestamp_layout=LAYOUT, term_count_border=2, pattern_key_regexes=(r"job (?P<patternKey>\w+) by (?P<who>\w+)",))
    one = ["2024-10-01T00:00:00 start job K1 by ann", "2024-10-01T00:00:01 step of k1 done", "2024-10-01T00:00:02 start job K2 by bob", "2024-10-01T00:00:03 other line"]
    two = ["2024-10-02T00:00:00 step of k1 done", "2024-10-02T00:00:01 step of k2 done", "2024-10-02T00:00:02 start job K2 by eve", "2024-10-02T00:00:03 step of k3 done"]
    for number, part in ((0, one), (1, two), (1, two)):  # the last feed is given again
        feeds.feed(spark.createDataFrame([(k, t, 0) for k, t in enumerate(part)], "ord long, line string, file_epoch long"), config, number)
    assert {tuple(r) for r in feeds.stored_tags(spark, config).collect()} == {("K1", "who", "ann"), ("K2", "who", "eve")}
    found = {(r["key"], r["start_epoch"], r["cnt"], len(r["pattern"].split())) for r in feeds.stored_patterns(spark, config).collect()}
    first = 1727740800
    assert found == {("K1", first, 1, 3), ("K2", first + 2, 1, 2), ("K2", first + 86402, 1, 1)}
    relations = {(r["key"], len(r["pattern"].split()), r["cnt"]) for r in feeds.stored_patterns(spark, config.with_values({"pattern_detection_mode": "relations"})).collect()}
    assert relations == {("who:ann", 3, 1), ("who:eve", 3, 1)}
    feeds.retain(spark, config.with_values({"keep_period": 1}))
    assert feeds.store_of(spark, config).read("pattern_keys").agg(F.min("block")).first()[0] == (first + 86400) // 86400
