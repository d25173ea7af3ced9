"""Near-duplicates and containment against brute force."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import containment, near_dups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    low = {i: i for i, _ in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                low[max(p, q)] = min(p, q)
    return {i: find(i) for i in low}


def edited(text, seed, share):
    r = random.Random(seed)
    w = text.split(" ")
    for k in r.sample(range(len(w)), int(share * len(w))):
        w[k] = f"edit{seed}x{k}"
    return " ".join(w)


@pytest.fixture(scope="module")
def families(prose):
    rows = [(100 + k, prose(k, 60)) for k in range(30)]
    base = prose(999, 120)
    rows += [(500 - k, edited(base, k, (0.0, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1)[k % 7])) for k in range(60)]
    rows += [(600 + k, base.upper() if k % 2 else base) for k in range(20)]
    chain = prose(77, 90).split(" ")
    rows += [(700 + k, " ".join(chain[2 * k : 2 * k + 50])) for k in range(15)]
    line = prose(5, 12)
    return rows + [(800 + k, line + " " + prose(2000 + k, 14)) for k in range(40)]


def test_near_duplicates_equal_brute_force(documents, families, odd_rows):
    rows = [r for r in families + [x[:2] for x in odd_rows] if True]
    got = near_dups.near_duplicates(documents(rows)).collect()
    want = components([r for r in rows if not (r[1] or "").startswith("x")])
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
    sizes = {i: len(shingles(t)) for i, t in rows if i is not None and rows.count((i, t)) == 1}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id in sizes)


def test_ids_with_several_texts_join_their_components(documents, prose):
    a, b = prose(1, 40), prose(2, 40)
    got = {(r.doc_id, r.component_id) for r in near_dups.near_duplicates(documents([(1, a), (2, a), (2, b), (3, b)])).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_links_at_the_border(documents):
    # 20 words have 16 shingles, 17 words 13 of those: 13 / 16 is over 3 / 4; 16 words have 12: exactly 3 / 4; 15 have 11
    w = [f"w{k}" for k in range(20)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:16])), (3, " ".join(["v" + x for x in w])), (4, " ".join(["v" + x for x in w[:15]]))]
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(documents(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_empty_table(documents):
    assert near_dups.near_duplicates(documents([(1, "x")]).limit(0)).count() == 0


def test_components_of_long_chains(spark, tmp_path):
    edges = [(k + 1, k) for k in range(200)] + [(1000, 1001), (1001, 1002)]
    got = {r.id: r.component for r in near_dups.components(spark.createDataFrame(edges, "u long, v long"), f"file://{tmp_path}/c").collect()}
    assert {got[k] for k in range(1, 201)} == {0} and {got[1001], got[1002]} == {1000}


def test_few_edges_are_joined_in_one_step_and_many_in_parts(spark, tmp_path):
    r = random.Random(3)
    pairs = [(r.randrange(600), r.randrange(600)) for _ in range(330)] + [(1000 - k, 1001 - k) for k in range(150)]
    low = {i: i for p in pairs for i in p}
    for _ in low:  # brute force: minima go along edges
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    want = {i: m for i, m in low.items() if i != m}
    edges = spark.createDataFrame(pairs * 2, "id long, lead long").repartition(5)
    got = [(r.id, r.component) for r in near_dups.components(edges, f"file://{tmp_path}/one").collect()]
    assert len(got) == len(want) and dict(got) == want
    assert os.listdir(tmp_path / "one") == ["forests"]
    assert dict(near_dups.components(edges, f"file://{tmp_path}/parts", most=40).collect()) == want
    assert "round0" in os.listdir(tmp_path / "parts")


def test_tables_that_are_written_do_not_grow_with_chains(spark, documents, families):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/siltstone"
    before = {x for x in os.listdir(root) if x.startswith("near-dups")} if os.path.isdir(root) else set()
    near_dups.near_duplicates(documents(families)).collect()
    (folder,) = {x for x in os.listdir(root) if x.startswith("near-dups")} - before
    written = [d for d, _, names in os.walk(f"{root}/{folder}") if "_SUCCESS" in names]
    assert len(written) <= 14, written


def test_pairs_of_many_ids_keep_their_rows(spark, tmp_path, monkeypatch):
    rows, pairs = spark.createDataFrame([(k, str(k)) for k in range(9)], "doc_id long, text string"), spark.createDataFrame([(5, 1), (7, 1), (5, 1)], "id long, lead long")
    few = near_dups.paired(rows, pairs, f"file://{tmp_path}/few").collect()
    monkeypatch.setattr(near_dups, "BROADCAST_IDS", 5)
    many = near_dups.paired(rows, pairs, f"file://{tmp_path}/many").collect()
    assert sorted(few) == sorted(many) == [(1, "1"), (5, "5"), (7, "7")] and os.listdir(tmp_path) == ["many"]


def test_containment_equals_brute_force(spark, documents, prose, odd_rows):
    items = [(k, prose(3000 + k, n)) for k, n in enumerate((3, 5, 6, 9, 15, 40, 41, 90, 200, 16, 16))] + [(50, None), (51, ""), (50, prose(3005, 40))]
    rows = [(k, prose(4000 + k, 80)) for k in range(20)]
    for k, (_, text) in enumerate(items[:11]):
        w = text.split(" ")
        for j, share in enumerate((1.0, 0.9, 0.8, 0.6)):
            rows.append((100 + 10 * k + j, prose(k + j, 300) + " " + " ".join(w[: max(1, int(share * len(w)))]).title() + "\n" + prose(k, 500)))
    rows += [(900, items[0][1]), *[r[:2] for r in odd_rows]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    sets = [(i, shingles(t)) for i, t in set(items) if shingles(t)]
    want = sorted((d if d is not None else -1, i, len(q & shingles(t)), len(q)) for d, t in rows for i, q in sets if 100 * len(q & shingles(t)) >= 75 * len(q))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, r.n_shared, r.n_item) for r in containment.contaminated(documents(rows), benchmark).collect())
    assert got == want and want
    kept = containment.decontaminated(documents(rows), benchmark)
    bad = {d for d, *_ in want}
    assert kept.columns == documents(rows).columns
    assert kept.count() == sum(d not in bad for d, _ in rows)
    assert containment.contaminated(documents(rows), benchmark.limit(0)).count() == 0


def test_items_in_blocks_find_the_same(spark, documents, prose, monkeypatch):
    items = [(k, prose(k, 20)) for k in range(12)]
    rows = [(k, prose(50, 30) + " " + prose(k, 20)) for k in range(12)]
    monkeypatch.setattr(containment, "BLOCK_BYTES", 300)
    got = containment.contaminated(documents(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(k, k) for k in range(12)]
    assert containment.decontaminated(documents(rows), spark.createDataFrame(items, "item_id long, text string")).where(F.col("doc_id") >= 0).count() == 0
