"""HTML extraction by nearest-URL page differencing.

Pages of a host are ordered by URL path, so the page with the longest common path is the one before or
after. Text lines are aligned with those by longest common subsequence, and shared lines go: outside
an article element those shared with the nearer page, inside one those shared with both.
"""

from __future__ import annotations

import html
import os.path
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import BROADCAST_IDS, shared_folder, slices, small_batches, stored

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:"[^"]*"|'[^']*'|[^>"']|["'])*))(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true""", re.I)

# Elements whose text is no text of the page, elements that aren't the article's,
# elements that begin a block, and names that mark an element as something beside the article.
RAW = set("script style noscript template textarea title iframe object svg math select option button".split())
BESIDE = set("nav aside footer form dialog menu".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MARKS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead notice cookie cookies consent popup modal newsletter subscribe signup comment comments reply replies disqus share sharing social related recommended widget toolbar pagination pager login search".split()
)
ROLES = set("navigation banner complementary contentinfo search dialog alert menu menubar form".split())
WITHIN = ("article", "main")


def _marked(attributes: str) -> bool:
    """Does its class, id or role, or being hidden, make an element something beside the article?"""
    for key, value in ATTRIBUTE.findall(attributes):
        words = set(re.split(r"[\s_\-\"']+", value.lower()))
        if words & (ROLES if key.lower() == "role" else MARKS):
            return True
    return bool(HIDDEN.search(attributes))


class Scope:
    """An open element beside the article. soft: by its marks alone, outside any article; it may yet hold the article."""

    def __init__(self, name: str, soft: bool):
        self.name, self.soft, self.depth, self.lists, self.holds = name, soft, 1, 0, ""

    def after(self, name: str, closing: bool) -> bool:
        """Is it still open after this tag? An unclosed p ends at any block, an unclosed li at its list's next item or end."""
        if self.name == "p" and (name in BLOCK or closing and name in BLOCK):
            return False
        if self.name == "li" and name in ("ul", "ol"):
            self.lists += -1 if closing else 1
            return self.lists >= 0
        if name == self.name:
            if name == "li" and not self.lists:
                return False
            self.depth += -1 if closing else 1
        return self.depth > 0


def lines(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, beside, within) of each block of a page in order.

    beside: in an element that isn't the article's (menu, footer, advert, comments...). within: in an
    article or main element. Marks (class, id, role) never make a main element, an outermost article or what
    holds a main element something beside the article, nor what holds the page's only articles. Tags
    may be unclosed or cut off; raw elements and comments have no text.
    """
    out: list[tuple[str, bool, bool, Scope | None]] = []
    parts: list[str] = []
    scopes: list[Scope] = []
    within = 0

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, any(not s.soft for s in scopes), within > 0, scopes[0] if scopes else None))
        parts.clear()

    page, at = page or "", 0
    while at < len(page):
        tag = TAG.search(page, at)
        parts.append(html.unescape(page[at : tag.start() if tag else len(page)]))
        if not tag:
            break
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        closing, attributes = bool(tag.group(1)), tag.group(3)
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW and not closing:
            if not attributes.endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in BLOCK or scopes and name == scopes[-1].name:
            flush()
        if name in VOID or attributes.endswith("/"):
            continue
        for k, scope in enumerate(scopes):
            if not scope.after(name, closing):
                del scopes[k:]
                break
        if name in WITHIN:
            if not closing and within and name == "article" and _marked(attributes):
                scopes.append(Scope(name, False))
            elif not any(not s.soft for s in scopes):
                within = max(0, within + (-1 if closing else 1))
                for scope in scopes:
                    scope.holds = "main" if "main" in (name, scope.holds) else name
        elif not closing and not any(not s.soft for s in scopes):
            if name in BESIDE or name == "header" and not within:
                flush()
                scopes.append(Scope(name, False))
            elif attributes and name not in ("body", "html") and _marked(attributes):
                flush()
                scopes.append(Scope(name, not within))
    flush()
    only = not any(inside and not beside and not scope for _, beside, inside, scope in out)
    held = lambda scope: scope is None or scope.holds == "main" or scope.holds == "article" and only
    return [(text, beside or not held(scope), inside) for text, beside, inside, scope in out]


#: Bits of the table of a longest common subsequence that is kept whole.
MOST_BITS = 1 << 31


def _common(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence, by rows of bits (one for each line of b)."""
    if not a or not b:
        return []
    if len(a) * len(b) > MOST_BITS and len(b) > 1:  # too many bits to keep: halve b, and split a where both halves do best
        half = len(b) // 2
        left, right = _row(a, b[:half]), _row(a[::-1], b[half:][::-1])[::-1]
        cut = int((left + right).argmax())
        return _common(a[:cut], b[:half]) + [cut + k for k in _common(a[cut:], b[half:])]
    masks: dict = {}
    for k, line in enumerate(a):
        masks[line] = masks.get(line, 0) | 1 << k
    full = (1 << len(a)) - 1
    row, rows = full, [full]
    for line in b:
        match = row & masks.get(line, 0)
        row = ((row + match) | (row - match)) & full
        rows.append(row)
    out, k, j = [], len(a), len(b)
    while k and j:  # a zero bit in a row: one more line is matched with that line of a
        if rows[j] >> (k - 1) & 1:
            k -= 1
        elif not rows[j - 1] >> (k - 1) & 1:
            j -= 1
        else:
            out.append(k - 1)
            k, j = k - 1, j - 1
    return out[::-1]


def _row(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of b with each head of a."""
    masks: dict = {}
    for k, line in enumerate(a):
        masks[line] = masks.get(line, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for line in b:
        match = row & masks.get(line, 0)
        row = ((row + match) | (row - match)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def shared_lines(own: list[str], other: list[str]) -> set[int]:
    """Places of the lines of `own` that a longest common subsequence shares with `other`."""
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    known = set(other[head : len(other) - tail])
    places = [k for k in range(head, len(own) - tail) if own[k] in known]
    middle = {own[k] for k in places}
    found = _common([own[k] for k in places], [x for x in other[head : len(other) - tail] if x in middle])
    return {*range(head), *(places[k] for k in found), *range(len(own) - tail, len(own))}


def nearer(path: str, before: str | None, after: str | None) -> int:
    """0 or 1: which of the two paths has more of this path's beginning; the one before if equal."""
    common = lambda other: -1 if other is None else len(os.path.commonprefix((path, other)))
    return int(common(after) > common(before))


def deleted(page: Page, before: Page | None, after: Page | None) -> list[int]:
    """Places of the page's lines that differencing deletes.

    A neighbour that has all the lines that aren't beside the article is a copy and says nothing. A line
    outside article elements goes if the nearer of the other neighbours has it too; one inside if
    all others have it, unless that were more than half of the article.
    """
    own = [k for k, kind in enumerate(page.kinds) if kind != BESIDE_IT]
    told = []
    for k in (0, 1) if not nearer(page.path, before and before.path, after and after.path) else (1, 0):
        neighbour = (before, after)[k]
        if neighbour and own:
            shared = shared_lines(page.hashes, neighbour.hashes)
            if not shared.issuperset(own):
                told.append(shared)
    if not told:
        return []
    inside = [k for k in own if page.kinds[k] == WITHIN_IT]
    shared = [k for k in inside if all(k in t for t in told)]
    if 2 * sum(page.sizes[k] for k in shared) > sum(page.sizes[k] for k in inside):
        shared = []
    return sorted([k for k in own if page.kinds[k] == FREE and k in told[0]] + shared)


#: Kinds of lines: beside the article, in an article or main element, neither.
BESIDE_IT, WITHIN_IT, FREE = range(3)


class Page(NamedTuple):
    path: str
    hashes: list[int]
    kinds: list[int]
    sizes: list[int]


PAGE = "path string, hashes array<long>, kinds array<int>, sizes array<int>"
SLIM = f"id long, own long, host string, {PAGE}"
DECIDED = f"id long, own long, host string, drop array<int>, {', '.join(f'{x}_{p}' for x in ('page', 'before', 'after') for p in PAGE.split(', '))}"


def _slim(batches):
    """The lines of each page as hashes."""
    for whole in batches:
        for batch in slices(whole, "html"):
            pages = [lines(p) for p in batch.column("html").to_pylist()]
            hashes = [[xxhash.xxh3_64_intdigest(x[0].encode("utf-8", "surrogatepass")) - (1 << 63) for x in p] for p in pages]
            kinds = [[BESIDE_IT if x[1] else WITHIN_IT if x[2] else FREE for x in p] for p in pages]
            sizes = [[len(x[0]) for x in p] for p in pages]
            columns = [*(batch.column(c) for c in ("id", "own", "host", "path")), pa.array(hashes, pa.list_(pa.int64())), *(pa.array(c, pa.list_(pa.int32())) for c in (kinds, sizes))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SLIM.split(", ")])


def _decide(batches):
    """What each page of a sorted range loses; the range's first and last page of a host keep what is known of theirs."""
    names = [x.split()[0] for x in DECIDED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), *[pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())] * 3]
    none = (None,) * 4
    held, before = None, None

    def row(now, before, after, edge):
        at = (now[0], now[1], now[2])
        return (*at, None, *now[3], *(before or none), *(after or none)) if edge else (*at, deleted(now[3], before, after), *none * 3)

    def out(rows):
        rows = [r for r in rows if r[3] is None or r[3]]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    first = True
    for batch in batches:
        rows = []
        for i, own, host, *page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = (i, own, host, Page(*page))
            if held and held[:3] == now[:3] and held[3].path == now[3].path:  # a repeated row
                continue
            if held:
                same = held[2] == host
                rows.append(row(held, before, now[3] if same else None, first))
                before, first = held[3] if same else None, False
            held = now
        yield out(rows)
    if held:
        yield out([row(held, before, None, True)])


def _text(batches):
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = []
            for page, drop in zip(batch.column("html").to_pylist(), batch.column("drop").to_pylist(), strict=True):
                gone = set(drop or ())
                texts.append("\n".join(text for k, (text, beside, _) in enumerate(lines(page)) if not beside and k not in gone))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _edges(batches):
    """What the pages at the ends of ranges lose, now that both neighbours are known."""
    for batch in batches:
        rows = batch.to_pylist()
        page = lambda r, x: Page(*(r[f"{x}_{p}"] for p in Page._fields)) if r[f"{x}_hashes"] is not None else None
        drop = [deleted(page(r, "page"), page(r, "before"), page(r, "after")) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), pa.array(drop, pa.list_(pa.int32()))], names=["id", "own", "drop"])


def differences(pages: DataFrame, folder: str) -> DataFrame:
    """id, own and the places of deleted lines (drop), for those of the pages (id, own, host, path, html) that lose any.

    Pages go as hashes of their lines, so a shuffle moves a fraction of the html. They are sorted by host, path
    and id over all tasks, so a host with very many pages is many ranges; neighbours beyond a range's
    ends are found among the ranges' first and last pages, so the result does not depend on how ranges are cut.
    """
    order = ("host", "path", "id", "own")
    slim = stored(pages.mapInArrow(_slim, SLIM), f"{folder}/slim")  # else it is made twice, once to find the ranges
    found = slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_decide, DECIDED)
    found = stored(found, f"{folder}/decided")
    ends = found.where("drop is null")
    along = Window.partitionBy("host").orderBy("page_path", "id", "own")
    page = F.struct(*[F.col(f"page_{p}").alias(p) for p in Page._fields])
    ends = ends.withColumns({"b": F.lag(page).over(along), "a": F.lead(page).over(along)})
    sides = {f"{x}_{p}": F.coalesce(F.col(f"{x}_{p}"), F.col(f"{x[0]}.{p}")) for x in ("before", "after") for p in Page._fields}
    ends = ends.withColumns(sides).drop("a", "b", "drop", "host").mapInArrow(_edges, "id long, own long, drop array<int>")
    return found.where("drop is not null").select("id", "own", "drop").union(ends.where("size(drop) > 0"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages (page_id, url, html).

    A page's neighbours are those before and after it on its host, by path and id; a page without any keeps
    all lines that aren't beside the article. Null or empty html has an empty text; a null url is
    a host of its own with no path; repeated rows are one page for differencing and a row each in the
    result, and copies under other ids say nothing of each other. Other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = shared_folder(spark, "html")
    bare = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumns({"id": F.coalesce("page_id", F.lit(-1)), "own": F.xxhash64("page_id", "url", "html")})
    keyed = rows.select("id", "own", F.lower(F.regexp_extract(bare, r"^[^/?#]*", 0)).alias("host"), F.regexp_replace(bare, r"^[^/?#]*", "").alias("path"), "html")
    drops = stored(differences(keyed, folder), f"{folder}/drops")
    few = drops.select(F.count("*").alias("n"), F.coalesce(F.sum(F.size("drop")), F.lit(0)).alias("places")).first()
    drops = F.broadcast(drops) if 4 * few.n + few.places <= BROADCAST_IDS else drops
    return rows.join(drops, ["id", "own"], "left").select("page_id", "url", "html", "drop").mapInArrow(_text, "page_id long, url string, text string, n_chars long")
