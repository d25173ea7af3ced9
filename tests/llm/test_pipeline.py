"""The pipeline's stages against brute force, and as a whole."""

import __spark_entry__
import corpus_pipeline
from test_pairs import components, shingles

from siltstone.llm import language, quality_rules


def rows(prose):
    stop = " the of and to in is "
    text = lambda seed, n: stop.join(prose(seed + k, n // 4) for k in range(4))
    out = [(k, text(10 * k, 120)) for k in range(30)]
    out += [(100 + k, out[k][1] + " a word more") for k in range(5)] + [(200 + k, out[k][1]) for k in range(3)]
    out += [(300, None), (301, ""), (302, "short"), (303, "12 34 " * 20), (304, "a b c d e f g h " * 30), (None, text(9000, 100))]
    return out, [(1, prose(70000, 30)), (2, prose(70001, 12))]


def test_stages(spark, documents, prose, tmp_path):
    docs, items = rows(prose)
    docs += [(400, docs[8][1] + " " + items[0][1].upper() + " " + prose(80000, 60))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    frame = documents(docs)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "language", "near-duplicates", "decontamination", "packing"]
    kept = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)

    one = kept["quality rules"](spark, frame, str(tmp_path))
    assert ids(one) == ids(quality_rules.rated(frame).where("kept")) and 304 not in ids(one) and 0 in ids(one)
    two = kept["language"](spark, one, str(tmp_path))
    assert ids(two) == ids(one)
    assert ids(kept["language"](spark, frame, str(tmp_path))) == ids(language.identified(frame).where("lang_pred <> 'und' and score >= 0.5"))
    three = kept["near-duplicates"](spark, two, str(tmp_path))
    low = components([(r.doc_id, r.text) for r in two.collect()])
    assert ids(three) == sorted([i for i in low if low[i] == i] + [None], key=str)
    four = kept["decontamination"](spark, three, str(tmp_path))
    held = {r.doc_id for r in three.collect() for _, t in items if 100 * len(shingles(t) & shingles(r.text)) >= 75 * len(shingles(t))}
    assert held and ids(four) == [i for i in ids(three) if i not in held]
    five = kept["packing"](spark, four, str(tmp_path))
    assert {r.doc_id for r in five.collect()} == set(ids(four))
    assert one.columns == two.columns == three.columns == four.columns == frame.columns

    frame.write.parquet(f"file://{tmp_path}/documents.parquet")
    whole = corpus_pipeline.run(spark, f"file://{tmp_path}")
    tokens = lambda df: sorted(((r.doc_id, r.doc_tokens, r["sum(length)"]) for r in df.groupBy("doc_id", "doc_tokens").sum("length").collect()), key=str)
    assert tokens(whole) == tokens(five)


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{k}_" for k in range(1, 11)} <= {n.split("_")[0] + "_" for n in names}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
