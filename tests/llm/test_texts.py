"""Quality rules, HTML, archives and licences against brute force and by hand."""

import base64
import collections
import hashlib
import random
import re

import pyarrow as pa

from siltstone.llm import html_text, licenses, quality_rules, warc
from siltstone.llm.common import Words, shingle_set, slices, text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_buffers(odd_rows):
    texts = [r[1] for r in odd_rows]
    w = Words(pa.array(["skipped", *texts], pa.string()).slice(1))
    assert [b - a for a, b in zip(w.first, w.first[1:], strict=False)] == [len(WORD.findall(t or "")) for t in texts]
    assert len(shingle_set("a b c")) == 1 and len(shingle_set("a b c d e f a b c d e")) == 6 and len(shingle_set(None)) == 0  # abcde is there twice
    assert list(shingle_set("A b C d E")) == list(shingle_set("a B c D e")) and list(shingle_set("a b")) != list(shingle_set("b a"))
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    assert sum(b.num_rows for b in slices(batch, "text", most=100)) == len(texts) and len(text_bytes(pa.array([], pa.string()))[1]) == 1


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.defaultdict(list)
    for k in range(len(w) - 7):
        windows[tuple(w[k : k + 8])].append(k)
    repeated = {p + j for places in windows.values() if len(places) > 1 for p in places for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w)


def test_quality_rules_equal_brute_force(documents, odd_rows, prose):
    rows = [r[:2] for r in odd_rows] + [(20, prose(1, 40) + "\n" + prose(1, 40)), (21, "a b c d e f g h " * 9), (22, "x " * 30), (23, prose(2, 30) + "\n" + prose(3, 9) + "\n" + prose(3, 9) + "\n" + prose(2, 8)), (24, "the " + prose(4, 50) + " of the"), (25, "* | ".join(prose(5, 60).split(" ")))]
    got = quality_rules.rated(documents(rows)).collect()
    assert sorted((str(r.doc_id), *r[1:7]) for r in got) == sorted((str(i), *rules(t)) for i, t in rows)
    kept = {r.doc_id for r in got if r.kept}
    assert 24 in kept and not {1, 2, 21, 22, 25} & kept and not any(r.kept and r.base_failed for r in got)
    passing = quality_rules.passing(documents(rows))
    assert passing.columns == documents(rows).columns and passing.count() == sum(r.kept for r in got)
    assert quality_rules.rated(documents(rows).limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body><header>Top <b>site</b></header><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div class="site-sidebar ad"><div>inner</div> still ad</div><main><article class="post"><h1>Head &amp; line</h1><p>One   two<br>three &lt;b&gt; <i>it</i>alic<p>Unclosed <!-- no --> text</p><div id="comments"><article>Nice!</article></div><form>f</form><p hidden>gone</p><section>Last&nbsp;one</section></article></main><footer>&copy; x</footer></body></html>"""


def test_html_lines():
    kept = [x[0] for x in html_text.lines(PAGE) if not x[1]]
    assert kept == ["Head & line", "One two three <b> italic", "Unclosed text", "Last one"]
    assert html_text.lines(None) == [] and html_text.lines("") == []
    assert [x[0] for x in html_text.lines("<p>cut <b>short<a hre")] == ["cut short"]
    assert [x[0] for x in html_text.lines("a < b <script>x")] == ["a < b"]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_marks_never_drop_what_holds_the_article():
    kept = lambda page: [x[0] for x in html_text.lines(page) if not x[1]]
    assert kept('<main class="search-results"><p>a</p></main>') == ["a"]
    assert kept('<div class="banner-image"><nav>n</nav><article><p>b</p><div class="ad">x</div></article></div><p class="ad">y</p>') == ["b"]
    assert kept('<article class="post has-comments"><p>c</p></article>') == ["c"]
    assert kept('<div class="related"><article>other</article></div><article>own</article><div class="related"><article>third</article></div>') == ["own"]
    assert kept('<aside><article>no</article></aside><div id="login"><main>yes</main></div>') == ["yes"]
    assert kept('<article><p>x</p><section id="comments"><article>Nice!</article></section><article class="comment">No</article><p>y</p></article>') == ["x", "y"]


def test_unclosed_elements():
    kept = lambda page: [x[0] for x in html_text.lines(page) if not x[1]]
    assert kept("<head><title>t</title><script>'<p>'</script><meta charset=x><body><p>in</p>") == ["in"]
    assert kept('<p class="notice">x<p>one<p>two</p><div><p class="ad">y</div>three') == ["one", "two", "three"]
    assert kept('<ul><li class="ad">x<ul><li>inner</ul><li>one<li>two</ul>three<ul><li class="ad">y</ul>four') == ["one", "two", "three", "four"]
    assert kept("&am<b>p;</b> &amp;&lt;") == ["&amp; &<"]


def test_shared_lines_are_a_longest_common_subsequence(monkeypatch):
    r = random.Random(2)
    for turn in range(300):
        monkeypatch.setattr(html_text, "MOST_BITS", 1 << 31 if turn % 2 else 4)
        a, b = [r.choice("abcd") for _ in range(r.randint(0, 14))], [r.choice("abcde") for _ in range(r.randint(0, 14))]
        places = html_text._common(a, b)
        rest = iter(b)
        assert places == sorted(set(places)) and all(a[k] in rest for k in places) and len(places) == lcs(a, b)
        assert html_text._row(a, b).tolist() == [lcs(a[:k], b) for k in range(len(a) + 1)]
        assert len(html_text.shared_lines(a, b)) == lcs(a, b)


def test_pages_are_compared_with_their_neighbours(spark):
    page = lambda body: f"<body><p>Shared top</p>{body}<p>Shared end</p></body>"
    rows = [(1, "http://h.example/a/1", page("<p>first</p>")), (2, "http://h.example/a/2", page("<p>second</p><p>more</p>")), (3, "http://other.example/a", page("<p>alone</p>")), (4, None, None), (5, "http://c.example/1", page("")), (6, "http://c.example/2", page("")), (7, "x", "<article><p>Shared</p></article>"), (8, "x?y", "<article><p>Shared</p></article>"), (8, "x?y", "<article><p>Shared</p></article>")]
    got = collections.defaultdict(set)
    for r in html_text.extracted(spark.createDataFrame([(*x, "u") for x in rows], "page_id long, url string, html string, host string").repartition(1)).collect():
        got[r.page_id].add((r.text, r.n_chars))
    assert got[1] == {("first", 5)} and got[2] == {("second\nmore", 11)}
    assert got[3] == {("Shared top\nalone\nShared end", 27)} and got[4] == {("", 0)}
    assert got[5] == got[6] == {("Shared top\nShared end", 21)} and got[7] == got[8] == {("Shared", 6)}
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def by_a_loop(pages):
    """Each page's text: sorted by host and path, with the neighbours' lines; the rule of each kind of line by hand."""
    key = lambda p: re.match(r"(?:[a-z]+://)?([^/?#]*)(.*)", p[1]).groups() + (p[0], p[2])
    ordered = sorted(set(pages), key=key)
    out = {}
    for k, p in enumerate(ordered):
        host, path, *_ = key(p)
        own, told = html_text.lines(p[2]), []
        for near in (k - 1, k + 1):
            if 0 <= near < len(ordered) and key(ordered[near])[0] == host:
                other = html_text.lines(ordered[near][2])
                shared = html_text.shared_lines([x[0] for x in own], [x[0] for x in other])
                begins = next((i for i, (a, b) in enumerate(zip(path, key(ordered[near])[1], strict=False)) if a != b), min(len(path), len(key(ordered[near])[1])))
                if any(not x[1] and i not in shared for i, x in enumerate(own)):
                    told.append((-begins, near, shared))
        told = [s for _, _, s in sorted(told, key=lambda x: x[:2])]
        inside = [i for i, x in enumerate(own) if x[2] and not x[1]]
        gone = {i for i in inside if told and all(i in s for s in told)}
        if 2 * sum(len(own[i][0]) for i in gone) > sum(len(own[i][0]) for i in inside):
            gone = set()
        gone |= {i for i, x in enumerate(own) if told and not x[1] and not x[2] and i in told[0]}
        out[p] = "\n".join(x[0] for i, x in enumerate(own) if not x[1] and i not in gone)
    return out


def test_differencing_equals_a_loop_and_does_not_depend_on_ranges(spark):
    r = random.Random(8)
    lines = lambda n: "".join(f"<p>{r.choice(('Weekly offer', 'News desk', 'Call us'))}</p>" if r.random() < 0.4 else f"<p>line {r.randrange(200)}</p>" for _ in range(n))
    rows = []
    for k in range(90):
        body = lines(r.randint(1, 6))
        body = r.choice((body, f"<article>{body}</article>", f"{lines(2)}<main>{body}{lines(3)}</main>"))
        rows.append((k, f"https://h{k % 7 % 3}.example/{r.choice(('a', 'b', 'news'))}/{r.randrange(30)}", f"<nav>Menu</nav>{body}<p>Weekly offer</p>"))
    rows += rows[:5] + [(500, rows[7][1], rows[7][2])]
    want = by_a_loop(rows)
    assert any("Weekly offer" in h and "Weekly offer" not in t for (_, _, h), t in want.items() if "<article>" in h)
    for parts in (1, 40):
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = html_text.extracted(frame).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert len(got) == len(rows)
        texts = {(p[0], p[1]): t for p, t in want.items()}
        assert all(r.text == texts[r.page_id, r.url] and r.n_chars == len(r.text) for r in got)


def test_the_nearer_neighbour_decides(spark):
    pages_ = [(1, "http://h/about", "<p>News desk</p><p>about</p>"), (2, "http://h/news/1", "<p>News desk</p><p>Latest</p><p>one</p>"), (3, "http://h/news/2", "<p>Latest</p><p>two</p>")]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(pages_, "page_id long, url string, html string")).collect()}
    assert got == {1: "about", 2: "News desk\none", 3: "two"}
    offer = [(k, f"http://h/{k}", f"<article><p>Read our weekly offer</p><p>long text of page number {k}</p></article>") for k in (1, 2)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(offer, "page_id long, url string, html string")).collect()}
    assert got == {k: f"long text of page number {k}" for k in (1, 2)}


def archived(pages):
    best = collections.defaultdict(lambda: None)
    for i, _, h in pages:
        if i is not None:
            best[h or ""] = max(i, best[h or ""] if best[h or ""] is not None else i)
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        first = best[h or ""]
        again = i is not None and i < first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def pages():
    trick = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:siltstone:page:999>\r\nContent-Length: 5\r\n\r\nHTTP/\r\n\r\n\r\n\r\n"
    rows = [(k, f"http://h/{k}", "<p>é" + "x" * (k * 7 % 50) + "</p>") for k in range(60)] + [(100 + k, None, trick * (k + 1) + "tail\r\n\r\n") for k in range(4)]
    return rows + [(200, "u\r\nContent-Length: 3", None), (201, "u", ""), (None, "n", "no id"), (7, "http://h/7", rows[7][2]), (300, "z", "no id"), (301, "z", "WARC/1.0\r\n"), (302, "z", "y" * 5000)]


def test_archives_round_trip(spark):
    frame = spark.createDataFrame([(*p, "t") for p in pages()], "page_id long, url string, html string, type string")
    got = sorted((tuple(r) for r in warc.archived(frame).collect()), key=str)
    assert got == archived(pages())
    assert warc.archived(frame.limit(0)).count() == 0
    alone = warc.archived(frame.where("page_id < 60"), least_bytes=10**6)
    assert {r.record_type for r in alone.collect()} == {"response"}


def test_files_of_many_parts_are_read_whole(spark, tmp_path):
    frame = spark.createDataFrame([p for p in pages() if p[0] is not None], "page_id long, url string, html string").repartition(2)
    warc.write(frame, f"file://{tmp_path}/a", compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        got = sorted((r.page_id, r.type, r.payload_bytes) for r in warc.read(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/f").collect() if r.type == "response")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(i, "response", n) for i, n, _, kind, _ in archived([p for p in pages() if p[0] is not None]) if kind == "response"]
    assert got == sorted(want)


def test_records_after_a_break_are_not_reached(spark, tmp_path):
    warc.write(spark.createDataFrame([(k, "u", "p" * k) for k in range(1, 6)], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/a", compression="none")
    file = next((tmp_path / "a").glob("part-*"))
    data = file.read_bytes()
    cut = data.index(b"page:3>")
    file.write_bytes(data[:cut] + b"page:3>\r\nX: " + data[cut + 9 :].replace(b"Content-Length", b"Content-Longth", 1))
    (tmp_path / "a" / f".{file.name}.crc").unlink(missing_ok=True)
    got = {r.page_id for r in warc.read(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/f").collect()}
    assert 1 in got and 5 not in got


def test_leaps():
    import numpy as np

    start = np.array([0, 10, 25, 30])
    assert warc.leaps(start, np.array([25, 30, 50, 28]), 30).tolist() == [50, -1, 50, -1]


def licences(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licences_equal_brute_force_and_find_notices(documents, odd_rows, prose):
    rows = [r[:2] for r in odd_rows] + [
        (20, prose(1, 50) + "\nReleased under the MIT License.\n" + prose(2, 20)), (21, "CC BY-NC 4.0 and cc by; GNU General\nPublic License"), (22, "mit-license Apache LICENSE, apache license"),
        (23, prose(3, 5) + " Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: " + prose(4, 5)),
        (24, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use"),
        (25, "a license to use the software in the public domain"), (26, "Licensed under CC BY-NC 4.0."), (27, "cc by nc"),
    ]
    got = licenses.scanned(documents(rows)).collect()
    assert sorted((str(r.doc_id), *r[1:6]) for r in got) == sorted((str(i), *licences(t)) for i, t in rows)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[20] == "mit" and labels[23] == "bsd" and labels[24] == "mit" and labels[25] == "" and labels[26] == "cc-by,cc-by-nc"
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 for r in got)
    assert licenses.scanned(documents(rows).limit(0)).count() == 0
