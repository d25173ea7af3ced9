"""Reports that are bounded on the screen say so, and are whole in files."""

from samples import FORMAT, LAYOUT

from siltstone import cli
from siltstone.sources.writers import bounded, pattern_report


def test_patterns_are_written_whole(spark, tmp_path):
    lines = [f"2024-10-01T00:{k // 60:02d}:{k % 60:02d}] open sid={k:04d} now" for k in range(120)]
    lines += [f"2024-10-01T01:{k // 60:02d}:{k % 60:02d}] closed by {k:04d}" for k in range(0, 120, 40)]  # a second pattern
    (tmp_path / "x.log").write_text("\n".join(lines))
    (tmp_path / "c.yml").write_text(f"logPath: '{tmp_path}/x.log'\nlogFormat: '{FORMAT}'\ntimestampLayout: '{LAYOUT}'\ntermCountBorder: 3\nminMatchRate: 0.3\npatternKeyRegexes: ['sid=(?P<patternKey>\\d+)']\noutDir: '{tmp_path}/out'\n")
    out = cli.main(["patterns", "-c", str(tmp_path / "c.yml"), "-N", "1"], spark)
    assert "only the first 100 rows" in out[-1]
    rows = spark.read.option("header", True).csv(str(tmp_path / "out/patterns.csv")).collect()
    assert {r["key"] for r in rows} == {f"{k:04d}" for k in range(120)} and sorted({int(r["total"]) for r in rows}) == [3, 117]
    texts = spark.read.option("header", True).csv(str(tmp_path / "out/patterns_groups.csv")).collect()
    assert {g for r in rows for g in r["pattern"].split()} == {r["group_id"] for r in texts} and all(r["display"] for r in texts)


def test_bounds_are_said(spark):
    found = spark.createDataFrame([("5 6", f"k{k}", 1, 1, 3) for k in range(3)], "pattern string, key string, start_epoch long, cnt long, total long")
    assert len(pattern_report(found, most=3)) == 5 and "only the first 2 rows" in pattern_report(found, most=2)[-1]
    assert bounded(found, 3)[1] == [] and len(bounded(found, 2)[0]) == 2
