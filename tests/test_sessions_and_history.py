import random
import statistics

from siltstone.operators import history, patterns


# Two sessions' series of groups, matched lines and times, and the patterns, starts and counts
# that they must give, here and in the test of relations.
def records(spark):
    one = zip("5 6 7 5 6 7 7 5 6 7 5".split(), [1, 0, 0, 1, 0, 0, 0, 1, 0, 0, 1], [1, 1, 2, 11, 11, 12, 12, 21, 21, 23, 30], strict=True)
    two = zip("5 6 7 7 5 6 7 9".split(), [1, 0, 0, 0, 1, 0, 0, 1], [15, 15, 16, 16, 25, 25, 26, 35], strict=True)
    rows = [(key, k, epoch, bool(m), int(g)) for key, part in (("1234", one), ("5678", two)) for k, (g, m, epoch) in enumerate(part)]
    return spark.createDataFrame(rows, "pattern_key string, ord long, epoch long, matched boolean, group_id long")


def as_map(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["pattern"], {})[r["key"]] = (r["start_epoch"], r["cnt"])
    return out


def test_first_match(spark):
    assert as_map(patterns.first_match(records(spark))) == {"5 6 7": {"1234": (1, 2), "5678": (25, 1)}, "5 6 7 7": {"1234": (11, 1), "5678": (15, 1)}, "5": {"1234": (30, 1)}, "9": {"5678": (35, 1)}}


def test_relations(spark):
    rows = [(p, k, epoch + k, True, int(g)) for p, epoch, s in (("p1", 1, "5 6 7"), ("p2", 11, "5 6 7"), ("p3", 15, "5 6 7"), ("p4", 25, "5 6 7 7")) for k, g in enumerate(s.split())]
    frame = spark.createDataFrame(rows, "pattern_key string, ord long, epoch long, matched boolean, group_id long")
    tags = spark.createDataFrame([("p1", "relationKey", "1234"), ("p2", "relationKey", "1234"), ("p3", "relationKey", "5678"), ("p4", "relationKey", "5678")], "pattern_key string, name string, value string")
    assert as_map(patterns.relations(frame, tags)) == {"5 6 7": {"relationKey:1234": (1, 2), "relationKey:5678": (15, 1)}, "5 6 7 7": {"relationKey:5678": (25, 1)}}
    assert set(as_map(patterns.relations(frame))["5 6 7"]) == {"all"}


def test_keys_tags_and_lines_of_sessions(spark):
    texts = ["open LegId=AB12 calling/called from1/to1", "leg ab12 rings", "noise", "leg ab12 ends", "leg zz9 before it opens", "open LegId=zz9 calling/called f2/t2"]
    rows = spark.createDataFrame([(k, t, 10 * k, t.lower().replace("=", " ").split(), k) for k, t in enumerate(texts)], "ord long, text string, epoch long, tokens array<string>, group_id long")
    keyed = patterns.keys(rows, (r"LegId=(?P<patternKey>\w+) calling/called (?P<from>\w+)/(?P<to>\w+)",))
    tags = {(r["pattern_key"], r["name"]): r["value"] for r in patterns.key_tags(keyed).collect()}
    assert tags == {("AB12", "from"): "from1", ("AB12", "to"): "to1", ("zz9", "from"): "f2", ("zz9", "to"): "t2"}
    assert {r["relation"] for r in patterns.tag_strings(patterns.key_tags(keyed)).collect()} == {"from:from1, to:to1", "from:f2, to:t2"}
    got = sorted((r["ord"], r["pattern_key"], r["matched"]) for r in patterns.associated(keyed).collect())
    assert got == [(0, "AB12", True), (1, "AB12", False), (3, "AB12", False), (5, "zz9", True)]


def anomalies_by_a_loop(series, k, least):
    mean, dev = statistics.fmean(series), statistics.pstdev(series)
    low, high = mean - k * dev, mean + k * dev
    signs = [1 if v > high else -1 if v < low else 0 for v in series]
    n = len(series)
    if any(all(signs[i] == signs[i + p] for i in range(n - p)) for p in range(2, n // 2 + 1)):
        return []
    return [(j, "disappearance" if series[j - 1] >= least and series[j] < low else "spike") for j in range(1, n) if series[j - 1] >= least and series[j] < low or series[j] > high]


def test_anomalies_equal_a_loop(spark):
    random.seed(3)
    series = {k: [random.choice((0, 1, 2, 3, 10, 40)) if random.random() < 0.2 else 20 for _ in range(random.randint(1, 20))] for k in range(60)}
    series[100] = [1, 9] * 6
    rows = [(k, 3600 * j, v) for k, s in series.items() for j, v in enumerate(s)]
    found = history.anomalies(spark.createDataFrame(rows, "g long, clock long, value long"), "g", 1.5, 10.0)
    got = sorted((r["g"], r["clock"] // 3600, r["kind"]) for r in found.collect())
    assert got == sorted((k, j, kind) for k, s in series.items() for j, kind in anomalies_by_a_loop(s, 1.5, 10.0)) and got


def test_dense_history_and_cells(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 7200), ("b", 3600), ("b", -5)], "g string, epoch long").selectExpr("g", "epoch + 3600 as epoch")
    cells = history.counted(rows, 3600, "g")
    dense = {(r["g"], r["clock"]): r["value"] for r in history.dense(cells.where("clock > 0"), 3600, "g").collect()}
    assert dense == {("a", 3600): 1, ("a", 7200): 0, ("a", 10800): 1, ("b", 3600): 0, ("b", 7200): 1, ("b", 10800): 0}
    asked = spark.createDataFrame([("a", 3600), ("a", 1), ("c", 3600)], "g string, clock long")
    assert sorted(r["value"] for r in history.cell(cells, "g", asked).collect()) == [-1, -1, 1]
    assert {r["g"] for r in history.largest(cells, "g", 1).collect()} == {"a"}
