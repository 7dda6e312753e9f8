"""Main text of web pages by nearest-URL differencing and markup.

A page is read into lines, one per block, each marked by where it stands:
article text, boilerplate (menus, headers, footers, sidebars, notices,
adverts, forms, comments) or neither. Marks never empty a page: an article
inside a marked wrapper is read again without the wrapper's mark, and a page that
is nothing but marked elements without class marks at all.

Every page is told apart from its neighbours. Pages of a host are put in the
order of their URL paths and queries and compared with both neighbours: lines are
aligned by longest common subsequence, and shared lines are deleted. What is left of
the article text is the main text; of a page without article text, or where nothing
is left of it, what is left of the unmarked lines. Pages whose lines are the same are
copies, compared as one.

Articles may share lines. Of unmarked pages that are nearly the same only short lines
that a third page of the host has too are deleted (a menu), since the rest may be an
article that two addresses carry. A line of article text is deleted only where most
pages of the host, and four at least, share it with the next one outside boilerplate (a
notice or advert inside the article); pages that share half the text are versions of it
and do not count.

Only line hashes are sorted and compared; the range partitions that hold them
hand their border pages to their neighbours, so that a host of any size spreads
over many tasks.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

ARTICLE, PLAIN, BOILERPLATE = 2, 1, 0
#: Share of the larger page's unmarked characters from which two pages are near copies;
#: there a shared line goes if it is shorter than SHORT characters and on so many pages.
NEAR, SHORT, TEMPLATE_PAGES = 0.9, 60, 3
#: Share of the larger page's unmarked and article characters from which two pages are
#: versions of one article; share of a host's pages that a notice inside articles exceeds, and how many at least.
VERSION, MOST, NOTICE_PAGES = 0.5, 0.5, 4
#: Cells of an alignment that are kept for reading it back; a larger one is split.
LCS_CELLS = 1 << 24

#: Elements whose content is no text, elements that are boilerplate,
#: elements that hold the article, and elements that start and end a line.
SILENT = "script style noscript template textarea title svg iframe object canvas head select option button audio video"
FRAME = "nav header footer aside form menu dialog fieldset search"
MAIN = "article main"
BLOCK = ("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
         "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption")
VOID = "area base br col embed hr img input link meta param source track wbr"
#: Words of a class, id or role that mark boilerplate.
MARKS = ("ad ads adv advert advertisement advertising banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent "
         "notice notices popup modal overlay comment comments disqus related share sharing social promo promotion sponsor sponsored newsletter "
         "subscribe subscription footer header masthead toolbar login search pagination pager skip widget contentinfo complementary")
#: First words of a name that say what the page has, and last words of one that names a wrapper.
STATES = "no not with without has is show hide js"
WRAPPERS = "result results wrap wrapper container layout page site content body inner outer main grid"

_SILENT, _FRAME, _MAIN, _BLOCK, _VOID, _MARKS, _STATES, _WRAPPERS = (
    frozenset(x.split()) for x in (SILENT, FRAME, MAIN, BLOCK, VOID, MARKS, STATES, WRAPPERS))
#: Elements that are followed from their start to their end tag.
_NESTED = (_FRAME | _MAIN | {"div", "section", "ul", "ol", "dl", "table", "blockquote", "figure", "details"}) - _VOID
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
#: How far class, id and role are believed: fully, not over articles, not at all.
ALL_MARKS, NOT_OVER_ARTICLES, NO_MARKS = range(3)


def _marks(attributes: str) -> set[str]:
    """Words of class, id and role that mark an element as boilerplate. A name whose first
    word states what a page has (``no-sidebar``), or whose last one is a wrapper's
    (``sidebar-wrap``), is no mark; of others every word counts."""
    found = set()
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = _WORD.findall(name)
            if words and not (len(words) > 1 and (words[0] in _STATES or words[-1] in _WRAPPERS)):
                found.update("comment" if w.startswith("comment") else w for w in words if w in _MARKS or w.startswith("comment"))
    return found


def _marked(name: str, attributes: str, state: int) -> bool:
    """Whether class, id, role or hiding make an element boilerplate."""
    if _HIDDEN.search(attributes):
        return True
    marks = _marks(attributes)
    if name in _MAIN:
        # readers' comments are articles too, by markup
        return "comment" in marks
    # a heading, or the head of an article, holds its title
    if state == ARTICLE or re.fullmatch("h[1-6]|hgroup", name):
        marks -= {"header", "masthead"}
    return bool(marks)


def lines(page: str | None) -> list[tuple[int, str]]:
    """(mark, text) of the non-empty lines of a page. Where class marks would leave nothing of
    a page, or nothing of its articles, they are believed less."""
    found = _lines(page, ALL_MARKS)
    if not any(m == ARTICLE for m, _ in found) and page and re.search(r"<(article|main)\b", page, re.I):
        again = _lines(page, NOT_OVER_ARTICLES)
        found = again if any(m == ARTICLE for m, _ in again) else found
    if found and all(m == BOILERPLATE for m, _ in found):
        again = _lines(page, NO_MARKS)
        found = again if any(m != BOILERPLATE for m, _ in again) else found
    return found


def _lines(page: str | None, belief: int) -> list[tuple[int, str]]:
    if not page:
        return []
    out: list[tuple[int, str]] = []
    words: list[str] = []
    opened: list[tuple[str, int]] = []
    state, at, size = PLAIN, 0, len(page)
    # a marked element without nested blocks (p, span, li ..): its name, and how deep
    muted, depth = "", 0

    def flush():
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                out.append((state, text))
            words.clear()

    while at < size:
        m = _TOKEN.match(page, at)
        if m is None:  # a "<" that opens nothing
            if not muted:
                words.append("&lt;")
            at += 1
            continue
        at = m.end()
        if m[4] is not None:
            if not muted:
                words.append(m[4] if m[4] != "<" else "&lt;")
            continue
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not closing and name in _SILENT and not m[3].endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if name == "head" and end is None:
                continue
            at = end.end() if end else size
            if name == "title":
                flush()
            continue
        if name in _BLOCK:
            flush()
            muted = ""
        elif name == "br":
            words.append(" ")
        elif muted == name:
            depth += -1 if closing else 1
            if depth == 0:
                muted = ""
            continue
        if name not in _NESTED:
            if not closing and not muted and state != BOILERPLATE and name not in _VOID and name != "body" and name != "html" \
                    and belief != NO_MARKS and m[3] and _marked(name, m[3], state):
                muted, depth = name, 1
            continue
        if not closing:
            if m[3].endswith("/"):
                continue
            opened.append((name, state))
            framed = any(n in _FRAME for n, _ in opened[:-1])
            marked = belief != NO_MARKS and _marked(name, m[3], state)
            if name in _FRAME and not (name == "header" and state == ARTICLE) or marked:
                state = BOILERPLATE
            elif name in _MAIN and (state != BOILERPLATE or belief == NOT_OVER_ARTICLES and not framed):
                state = ARTICLE
        elif any(n == name for n, _ in opened):
            while True:
                n, state = opened.pop()
                if n == name:
                    break
    flush()
    return out


def lcs(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (bit-parallel rows)."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid_a, mid_b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    middle = [lead + k for k in _aligned(mid_a, mid_b)] if mid_a and mid_b else []
    return [*range(lead), *middle, *range(len(a) - tail, len(a))]


def _row(a: list[int], b: list[int], rows: list[int] | None = None) -> int:
    """Last bit row of the alignment of ``a`` with ``b``: a zero bit k says that the length grows
    by one at position k of ``a``. ``rows`` receives all of them."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << k)
    row = full = (1 << len(a)) - 1
    for x in b:
        u = row & masks.get(x, 0)
        row = ((row + u) | (row - u)) & full
        if rows is not None:
            rows.append(row)
    return row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the alignment of ``b`` with every prefix of ``a``."""
    raw = np.frombuffer(_row(a, b).to_bytes(len(a) // 8 + 1, "little"), np.uint8)
    return np.r_[0, np.cumsum(np.unpackbits(raw, bitorder="little")[: len(a)] == 0)]


def _aligned(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence. Few cells are read back from the bit
    rows; many are split where the alignments of both halves of ``b`` are longest together."""
    if not a or not b:
        return []
    if len(a) * len(b) > LCS_CELLS and len(b) > 1:
        half = len(b) // 2
        cut = int(np.argmax(_lengths(a, b[:half]) + _lengths(a[::-1], b[half:][::-1])[::-1]))
        return _aligned(a[:cut], b[:half]) + [cut + k for k in _aligned(a[cut:], b[half:])]
    rows: list[int] = []
    _row(a, b, rows)
    i, j, back = len(a) - 1, len(b) - 1, []
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j > 0 and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            back.append(i)
            i -= 1
            j -= 1
    return back[::-1]


def _hash(text: str) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _place(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL, with its query sorted next to the path alone; one that cannot be read has an empty host."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "", parts.path.rstrip("/") + (f" {parts.query}" if parts.query else ""))
    except ValueError:
        return "", url or ""


def _keyed(batches):
    for batch in batches:
        place = [_place(u) for u in batch.column(1).to_pylist()]
        found = [lines(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([h for h, _ in place]), pa.array([p for _, p in place]),
             pa.array([[_hash(t) for _, t in x] for x in found], pa.list_(pa.int64())),
             pa.array([[_SIGN[m] * len(t) for m, t in x] for x in found], pa.list_(pa.int32()))],
            names=["key", "host", "path", "hashes", "sizes"])


#: Characters of a line are counted above zero if unmarked, below in article text, not in boilerplate.
_SIGN = {PLAIN: 1, ARTICLE: -1, BOILERPLATE: 0}


def _common(mine, sizes, other) -> tuple[list[int], bool, list[int], bool]:
    """Lines shared with a neighbour, whether it is a near copy by its unmarked lines, the shared lines
    of article text, and whether it is a version of the same text."""
    if other is None:
        return [], False, [], False
    keep, theirs = lcs(mine, other["hashes"]), other["sizes"]
    unmarked = max(sum(z for z in x if z > 0) for x in (sizes, theirs))
    text = max(sum(map(abs, x)) for x in (sizes, theirs))
    outside = {x for x, z in zip(other["hashes"], theirs) if z}
    return (keep, bool(unmarked) and sum(sizes[k] for k in keep if sizes[k] > 0) >= NEAR * unmarked,
            [k for k in keep if sizes[k] < 0 and mine[k] in outside], sum(abs(sizes[k]) for k in keep) >= VERSION * text)


def _shared(batches):
    """Lines (by number) of every page that it shares with a neighbour: unmarked ones, short unmarked ones
    shared with a near copy, and lines of article text; and the latter that the next page has too, if that is no version."""
    line = pa.list_(pa.struct([("at", pa.int32()), ("line", pa.int64())]))
    for batch in batches:
        mine, sizes, before, after = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
        sure, maybe, article, ahead = [], [], [], []
        for m, z, b, a in zip(mine, sizes, before, after):
            found = [_common(m, z, b), _common(m, z, a)]
            text = {k for x in found for k in x[2]}
            # unmarked lines matter where no article text may be left
            if sum(x < 0 for x in z) > len(text):
                plain = []
            else:
                plain = [([k for k in keep if z[k] > 0], near) for keep, near, *_ in found]
            sure.append(sorted({k for keep, near in plain if not near for k in keep}))
            maybe.append([{"at": k, "line": m[k]} for k in sorted({k for keep, near in plain if near for k in keep}) if z[k] < SHORT])
            article.append([{"at": k, "line": m[k]} for k in sorted(text)])
            _, _, following, version = found[1]
            ahead.append([] if version else sorted({m[k] for k in following}))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sure, pa.list_(pa.int32())), pa.array(maybe, line), pa.array(article, line),
             pa.array(ahead, pa.list_(pa.int64()))], names=["content", "host", "sure", "maybe", "article", "ahead"])


def neighbours(keyed: DataFrame, partitions: int) -> tuple[DataFrame, DataFrame]:
    """(content, host, hashes, sizes, before, after): the lines of every page and the pages next
    to it in its host; and all pages as they are dealt, written once."""
    order = ["host", "path", "content"]
    dealt = keyed.repartitionByRange(partitions, *order).withColumn("pid", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    inside = Window.partitionBy("pid").orderBy(*order)
    page = F.struct("host", "hashes", "sizes")
    rows = (dealt.withColumn("prev", F.lag(page).over(inside)).withColumn("next", F.lead(page).over(inside)))
    # one row per range partition: its first and last page, seen by the partitions beside it
    border = dealt.groupBy("pid").agg(F.min_by(page, F.struct(*order)).alias("lo"), F.max_by(page, F.struct(*order)).alias("hi"))
    chain = Window.orderBy("pid")
    border = border.select("pid", F.lag("hi").over(chain).alias("hi_before"), F.lead("lo").over(chain).alias("lo_after"))
    rows = rows.join(border, "pid")
    prev, after = F.coalesce("prev", "hi_before"), F.coalesce("next", "lo_after")
    near = rows.select("content", "host", "hashes", "sizes", F.when(prev["host"] == F.col("host"), prev).alias("before"),
                       F.when(after["host"] == F.col("host"), after).alias("after"))
    return near, dealt


def _text(batches):
    for batch in batches:
        out = []
        for page, shared in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            found, gone = lines(page), set(shared or ())
            left = [x for k, x in enumerate(found) if k not in gone]
            main = [t for m, t in left if m == ARTICLE] or [t for m, t in left if m == PLAIN]
            # a page that is nothing but an article found everywhere keeps it
            out.append("\n\n".join(main or [t for m, t in found if m == ARTICLE]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (blocks joined by a blank line, empty if none) and n_chars of every row.

    A null html is an empty page and of a host's exact copies each is answered; a null or unreadable URL has an empty host (such
    pages are neighbours of each other); repeated rows are compared once and each
    answered; pages without a neighbour keep all unmarked lines; an empty table gives none."""
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    key = F.xxhash64("page_id", "url", "html")
    keyed = cut_lineage(src.select(key.alias("key"), "url", "html").mapInArrow(
        _keyed, "key long, host string, path string, hashes array<long>, sizes array<int>")
        .withColumn("content", F.xxhash64("host", "hashes", "sizes")))
    partitions = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # copies on a host are one page, at their smallest path
    pages = keyed.groupBy("content").agg(F.min("path").alias("path"), F.first("host").alias("host"),
                                         F.first("hashes").alias("hashes"), F.first("sizes").alias("sizes"))
    near, dealt = neighbours(pages, partitions)
    compared = cut_lineage(near.mapInArrow(
        _shared, "content long, host string, sure array<int>, maybe array<struct<at: int, line: long>>, "
                 "article array<struct<at: int, line: long>>, ahead array<long>"))
    doubtful = compared.select("content", "host", F.explode("maybe").alias("m")).select("content", "host", "m.at", "m.line")
    # lines on several pages of a host, once for each page
    hosts = doubtful.select("host").distinct()
    counted = dealt.join(hosts, "host", "left_semi").select("host", F.explode(F.array_distinct("hashes")).alias("line"))
    template = counted.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= TEMPLATE_PAGES).select("host", "line")
    menu = doubtful.join(template, ["host", "line"], "left_semi").select("content", "at")
    # lines of article text that most pages of a host share with the next one
    follows = dealt.groupBy("host").agg((F.count("*") - 1).alias("pairs"))
    notice = (compared.select("host", F.explode("ahead").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
              .where(F.col("n") >= NOTICE_PAGES - 1).join(follows, "host").where(F.col("n") > MOST * F.col("pairs")).select("host", "line"))
    notices = (compared.select("content", "host", F.explode("article").alias("m")).select("content", "host", "m.at", "m.line")
               .join(notice, ["host", "line"], "left_semi").select("content", "at"))
    shared = (compared.select("content", F.explode("sure").alias("at")).unionAll(menu).unionAll(notices)
              .groupBy("content").agg(F.collect_set("at").alias("shared")))
    wanted = shared.join(keyed.select("key", "content").distinct(), "content").select("key", "shared")
    wanted = cut_lineage(wanted)
    joined = src.withColumn("key", key).join(wanted, "key", "left").select("page_id", "url", "html", "shared")
    return joined.mapInArrow(_text, "page_id long, url string, text string, n_chars long")
