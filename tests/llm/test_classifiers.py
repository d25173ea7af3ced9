"""Classifiers by held-out accuracy, and on odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import labelled, language, quality_classifier, toxicity

SYLLABLES = {"aa": "the an er in on re", "bb": "sch ein ung der keit ß", "cc": "que é au oi les è"}


def held_out(doc_id, folds, k):
    return (0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds) == k


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        lang = r.choice(list(SYLLABLES))
        body = text(r, lang, r.randint(8, 200))
        good, toxic = r.random() < 0.8, r.random() < 0.2
        if not good:
            body = r.choice((lambda b: b.upper().replace(" ", "!! "), lambda b: b.replace(" ", " | "), lambda b: " ".join(w + "###" for w in b.split())))(body)
        if toxic:
            w = body.split(" ")
            for _ in range(1 + len(w) // 50):
                w.insert(r.randrange(len(w)), r.choice(("idio", "scumm", "vequ", "lowei")) + r.choice("abcdefghi") + r.choice(("t", "lo", "n")))
            body = " ".join(w)
        rows.append((k, body, lang))
        labels.append((k, int(good), int(toxic)))
    return rows, labels


def frame(spark, labels):
    return spark.createDataFrame([(*x, "l") for x in labels] + [(None, 1, 1, "l"), (5, None, None, "l")], "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize(("operator", "column"), [(quality_classifier.scored, 1), (toxicity.scored, 2)])
def test_held_out_accuracy(spark, documents, corpus, odd_rows, operator, column):
    rows, labels = corpus
    odd = [(1000 + (r[0] or 0), *r[1:]) for r in odd_rows]
    got = operator(documents(rows + odd + [(None, "no id")]), frame(spark, labels)).collect()
    assert len(got) == len(rows) + len(odd) + 1
    truth = {x[0]: x[column] for x in labels}
    own = [r for r in got if r.doc_id in truth and r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in own]) > 0.95 and len(own) > 50
    for r in got:
        assert r.held_out == held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= (0.3 if column == 1 else 0.5))


@pytest.mark.parametrize("operator", [quality_classifier.scored, toxicity.scored])
def test_without_labels(spark, documents, corpus, operator):
    rows = corpus[0][:5]
    got = operator(documents(rows), frame(spark, []).where("doc_id < 0")).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1
    assert operator(documents(rows).limit(0), frame(spark, corpus[1])).count() == 0


def test_unseen_misspellings_are_toxic(spark, documents, corpus):
    rows, labels = corpus
    r = random.Random(1)
    new = [(5000 + k, text(r, "aa", 400) + " " + w + " " + text(r, "aa", 300)) for k, w in enumerate(("idiozz", "scummy", "vequzzz", "loweiklo"))] + [(6000 + k, text(r, "bb", 700)) for k in range(20)]
    got = {x.doc_id: x.score for x in toxicity.scored(documents(rows + new), frame(spark, labels)).collect()}
    assert min(got[5000 + k] for k in range(4)) > 0.2 and max(got[6000 + k] for k in range(20)) < 0.1


def test_languages(documents, corpus, odd_rows):
    rows = corpus[0]
    odd = [(1000 + (x[0] or 0), *x[1:]) for x in odd_rows]
    got = language.identified(documents(rows + odd)).collect()
    truth = {x[0]: x[2] for x in rows}
    own = [x for x in got if x.held_out and x.doc_id in truth]
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in own]) > 0.97
    assert all(x.held_out == held_out(x.doc_id, 4, 2) and 0 <= x.score <= 1 for x in got)
    none = {x.doc_id for x in got if x.lang_pred == "und"}
    assert none == {1000 + (x[0] or 0) for x in odd_rows if not any(c.isalpha() for c in x[1] or "")} - {1000 + (x[0] or 0) for x in odd_rows if any(c.isalpha() for c in x[1] or "")} | {1000}
    kept = language.in_a_language(documents(rows + odd))
    assert kept.columns == documents(rows).columns and kept.where("doc_id < 1000").count() == len(rows)
    assert {x.lang_pred for x in language.identified(documents([(1, "abc", None)])).collect()} == {"und"}
    assert language.identified(documents(rows).limit(0)).count() == 0


def test_dual_descent_equals_a_plain_solver():
    """The hinge loss's dual with a box, by projected gradient steps on the dense problem."""
    r = np.random.default_rng(3)
    size = 40
    docs = [np.unique(r.choice(size, 8)).astype(np.int32) for _ in range(30)]
    labels, scales = (r.random(30) < 0.4).astype(int), r.normal(0, 1, size)
    w = quality_classifier.dual_descent(docs, scales, labels, 3000)
    y = np.where(labels == 1, 1.0, -1.0)
    x = np.zeros((30, size + 1))
    for k, d in enumerate(docs):
        x[k, d] = scales[d] / np.linalg.norm(scales[d])
    x[:, -1] = 1
    cost = quality_classifier.COST * 30 / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(30)
    for _ in range(60_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert abs(loss(w) - loss((alpha * y) @ x)) < 1e-3 * loss(w)


def bags_by_a_loop(text, z):
    words = []
    for w in "".join(chr(toxicity._SEEN[b]) for b in (text or "").encode()).split(" "):
        w = w.encode("latin-1")
        while w and toxicity._EDGE[w[0]]:
            w = w[1:]
        while w and toxicity._EDGE[w[-1]]:
            w = w[:-1]
        if w:
            whole = b" " + w + b" "
            grams = [whole[k : k + n] for n in toxicity.SIZES for k in range(max(len(whole) - n + 1, 0))]
            buckets = []
            for g in grams:
                key = len(g)
                for b in g:
                    key = (key * 0x100000001B3 + b) % (1 << 64)
                buckets.append(int(toxicity.mix64(np.array([key], np.uint64))[0]) >> 47)
            words.append(sum(float(z[b]) for b in buckets) / max(len(buckets), 1))
    half = toxicity.BAG // 2
    bags = [words[k : k + toxicity.BAG] for k in range(0, max(len(words) - half, 1), half)] if words else []
    return max((sum(b) / len(b) for b in bags), default=-np.inf)


def test_worst_bags_equal_a_loop(odd_rows):
    z = np.random.default_rng(2).normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    texts = [r[1] for r in odd_rows if len(r[1] or "") < 5000] + ["scum!! and", "##moron###", "f*ck -a- b'c!", "!!! ### x", "a b c d e f g", "*", "x! !y", "Ab, cD; é-é"]
    got = toxicity.worst_bags(pa.array(texts, pa.string()), z)
    assert np.allclose(got, [bags_by_a_loop(t, z) for t in texts], atol=1e-4)
    one, two = toxicity.worst_bags(pa.array(["so scum!! it", "so scum it"]), z)
    assert abs(one - two) < 1e-6


def test_samples_are_bounded_by_bytes(spark, documents, prose):
    rows = [(k, prose(k, 50)) for k in range(40)] + [(90, "x" * 100_000)]
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in rows], "doc_id long, quality int, toxic int")
    found = labelled.sample(documents(rows), labels, "quality", 100, most=5000).collect()
    size = sum(len(r["text"]) for r in found)
    assert 4000 < size <= 5000 and 90 not in {r["doc_id"] for r in found} and all(dict(rows)[r["doc_id"]] == r["text"] for r in found)
    assert len(labelled.sample(documents(rows), labels, "quality", 7).collect()) == 7


def test_the_share_of_learned_rows_is_exact():
    assert language.share_below(20_000, 20_000) is None and language.share_below(1, 2) == 0
    for total in (20_001, 10**6, 5 * 10**10, 10**13):
        below = language.share_below(20_000, total) + (1 << 63)
        assert abs(below * total / 2**64 - 20_000) < 0.01


def test_posteriors_equal_a_loop(documents, corpus):
    """Multinomial naive Bayes by hand, over the n-grams' buckets."""
    texts = [(t, g) for _, t, g in corpus[0][:60]]
    langs, logs = language.fit(documents([(k, t, g) for k, (t, g) in enumerate(texts)]))
    count = {g: np.full(language.BUCKETS, language.SMOOTHING) for g in langs}
    for t, g in texts:
        for b in language.ngrams([t])[0]:
            count[g][b] += 1
    new = [x[1] for x in corpus[0][60:90]]
    found, score = language.predict(new, langs, logs)
    for t, g, p in zip(new, found, score, strict=True):
        total = np.array([sum(np.log(count[k][b] / count[k].sum()) for b in language.ngrams([t])[0]) for k in langs])
        odds = np.exp(total - total.max())
        assert g == langs[int(total.argmax())] and abs(p - 1 / odds.sum()) < 1e-2


def test_ngrams_equal_a_loop():
    texts = ["Ab, cÉ", "", None, "x", "...", "日本\U0001f600z", "\U0001f600", "\U00020000"]
    got, row, letter = language.ngrams(texts)
    folded = [" ab cé ", "  ", "  ", " x ", "  ", " 日本 z ", "  ", " \U00020000 "]  # a row's space, and the next row's
    want = sum(f[k : k + n] != " " for f in folded for n in (1, 2, 3) for k in range(len(f) - n + 1))
    assert len(got) == want and letter.tolist() == [True, False, False, True, False, True, False, True]
    alone = [sorted(language.ngrams([t])[0].tolist()) for t in texts]
    assert alone == [sorted(got[row == k].tolist()) for k in range(len(texts))]


def test_indicators_are_distinct_and_by_row():
    texts = ["a b a b", "", None, "THE!! The!!", "x x x y"]
    flat, at = quality_classifier.indicators(pa.array(texts, pa.string()))
    parts = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert all(len(set(p.tolist())) == len(p) for p in parts) and len(parts[1]) == len(parts[2]) == 0
    for t, p in zip(texts, parts, strict=True):
        assert sorted(quality_classifier.indicators(pa.array([t], pa.string()))[0].tolist()) == sorted(p.tolist())
