"""Main text of web pages, by nearest-URL page differencing.

A page is a sequence of lines: the text of its blocks, in page order, each with the block's place in the document. Pages
of one host are put in the order of their URL paths, and each is paired with the neighbour whose path shares the longest
beginning. The two pages' lines are aligned by a longest common subsequence, and the lines that they share go: menus,
notices and footers that a template puts on both.

Markup decides what differencing can't. Scripts, styles, forms, navigation, side bars, comments and the like are never
content, also where a page fills them with words of its own. Lines of marked content (article, main) are content even if
a neighbour has them too: pages that copy each other's articles, or open them alike, share such lines as well. All else is
differencing's to decide: lines outside the marked content, all lines of pages that mark none, and lines in the marked
content whose class or id only looks like a mark ("share-price"). Pages of equal lines say nothing about each other: those
of one host are one sequence, which is compared with the next other one, and all of them take its shared lines.

Neighbours are found by a range sort of narrow rows (host, path, line hashes) over the whole table, so a host with a
third of all pages is spread like any other; where the order passes from one partition to the next, the rows next to the
border go to a table of at most two rows for each partition.
"""

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corvane.llm.common import settle

#: A tag; quoted attribute values may hold ">". The second form is for what follows a quote that never ends.
_TAG = re.compile(r"""<(/)?([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/)?([A-Za-z][A-Za-z0-9:-]*)([^>]*)>")
_ATTR = re.compile(r"""([A-Za-z][\w:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([A-Za-z][\w:-]*)""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
#: Their content is no markup; it ends at their own end tag only.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Inline elements: their borders don't end a block.
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Never content, wherever they stand.
_DROPPED = _RAW | set("head noscript template svg math canvas object video audio nav footer aside form button select option menu dialog fieldset".split())
#: Never content outside the marked content; inside, it holds the content's own heading.
_PAGE_ONLY = {"header"}
_CONTENT = {"article", "main"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
#: Words of class and id values that mark what is no content: alone, or in any compound ("ad-slot", "comments_list").
_MARKS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sidebar navbar navigation menubar breadcrumb breadcrumbs masthead comment comments disqus respond cookie cookies "
    "consent gdpr newsletter subscribe subscription pagination".split()
)
#: Words that do so alone only; what lies in their compounds is left to differencing where the page marks it as content.
_WEAK_MARKS = set(
    "banner promo promotion aside nav menu footer replies notice notices alert popup modal overlay signup login share sharing social related recommended recommendations widget toolbar pager skip".split()
)
_HEADS = {"header", "site-header", "page-header", "siteheader", "pageheader", "topbar"}
#: Longest common subsequences are read from a table of at most so many cells; longer sequences are halved first.
TABLE_CELLS = 4_000_000


def _marked(attrs: str) -> tuple[bool, bool, bool, bool]:
    """Whether attributes mark no content, look like it only, mark a page header, mark content."""
    if not _TELLING.search(attrs):
        return False, False, False, False
    out, doubtful, head, content = False, False, False, False
    for m in _ATTR.finditer(attrs):
        name = (m[1] or m[5]).lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            out = True
        elif name == "role":
            out |= value in _ROLES
            content |= value in ("main", "article")
        elif name in ("class", "id"):
            names = set(value.split())
            words = {w for n in names for w in re.split(r"[-_:]+", n)}
            out |= bool(words & _MARKS or names & _WEAK_MARKS)
            doubtful |= bool(words & _WEAK_MARKS)
            head |= bool(_HEADS & names)
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out = True
    return out, doubtful, head, content


Line = tuple[str, bool, bool, bool]


def page_lines(html: str | None) -> list[Line]:
    """The non-empty lines of a page: text, whether markup says it is no content, whether it lies in marked content, whether
    it lies there in what only looks like a mark of no content."""
    html = html or ""
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # of open elements: name, no content, content, doubtful
    n_open: Counter = Counter()
    parts: list[str] = []
    at, size = 0, len(html)

    def close_line() -> None:
        if parts:
            text = "".join(parts)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                lines.append((text, *(stack[-1][1:] if stack else (False, False, False))))
            parts.clear()

    tag = _TAG
    while at < size:
        start = html.find("<", at)
        if start < 0:
            parts.append(html[at:])
            break
        if start > at:
            parts.append(html[at:start])
        after = html[start + 1 : start + 3]
        if after[:1] in ("!", "?") and after:
            stop = html.find("-->" if html.startswith("!--", start + 1) else ">", start)
            at = stop + (3 if html.startswith("-->", stop) else 1) if stop >= 0 else size
            continue
        if not after.lstrip("/")[:1].isalpha():
            parts.append("<")
            at = start + 1
            continue
        m = tag.match(html, start)
        if not m and tag is _TAG:
            tag = _PLAIN_TAG
            m = tag.match(html, start)
        if not m:  # a tag that never ends
            break
        at = m.end()
        end, name, attrs = m.groups()
        name = name.lower()
        if end:
            found = None
            if n_open[name]:
                found = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
            if name not in _INLINE:
                close_line()
            elif found is not None and stack[found][1::2] != (stack[found - 1][1::2] if found else (False, False)):
                close_line()
            if found is not None:
                n_open.subtract(x[0] for x in stack[found:])
                del stack[found:]
            continue
        out, doubtful, head, content = _marked(attrs)
        above_out, above_content, above_doubt = stack[-1][1:] if stack else (False, False, False)
        content = (content or name in _CONTENT or above_content) and not above_out
        out = above_out or out or doubtful and not above_content or name in _DROPPED or (head or name in _PAGE_ONLY) and not above_content
        doubtful = (doubtful or above_doubt) and content and not out
        if name not in _INLINE or (out, doubtful) != (above_out, above_doubt):
            close_line()
        if name in _RAW:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else size
        elif name in _VOID:
            pass
        elif not attrs.rstrip().endswith("/") or name in _CONTENT:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # end where the next of their kind begins
                if stack and stack[-1][0] == name:
                    n_open[stack.pop()[0]] -= 1
            stack.append((name, out, content, doubtful))
            n_open[name] += 1
    close_line()
    return lines


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of `a` lie on a longest common subsequence with `b` (both as hashes). Equal beginnings and ends are
    set aside first; what is left is aligned whole."""
    shared = np.zeros(len(a), bool)
    n = min(len(a), len(b))
    head = n if (a[:n] == b[:n]).all() else int(np.argmin(a[:n] == b[:n]))
    m = n - head
    tail = 0 if not m else m if (a[len(a) - m :] == b[len(b) - m :]).all() else int(np.argmin((a[len(a) - m :] == b[len(b) - m :])[::-1]))
    shared[:head] = True
    if tail:
        shared[len(a) - tail :] = True
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    in_both = np.isin(x, y)
    keep_x, keep_y = np.flatnonzero(in_both), np.flatnonzero(np.isin(y, x))
    shared[head + keep_x[_lcs(x[keep_x], y[keep_y])]] = True
    return shared


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of `x` with each beginning of `y`."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum(np.maximum.accumulate(np.where(v == y, row[:-1] + 1, 0)), row[1:])
    return row


def _lcs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions in `x` of a longest common subsequence of two sequences. Where the table of lengths would have more than
    TABLE_CELLS cells, `x` is halved and `y` cut where the halves' lengths add up to the most (Hirschberg)."""
    if len(x) > 1 and len(x) * len(y) > TABLE_CELLS:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return np.r_[_lcs(x[:half], y[:cut]), half + _lcs(x[half:], y[cut:])]
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(1, len(x) + 1):
        step = np.where(x[i - 1] == y, table[i - 1, :-1] + 1, 0)
        table[i, 1:] = np.maximum(np.maximum.accumulate(step), table[i - 1, 1:])
    out, i, j = [], len(x), len(y)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            out.append(i - 1)
            i, j = i - 1, j - 1
    return np.array(out[::-1], np.int64)


def _hashes(lines: list[Line]) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(line[0].encode("utf-8", "surrogatepass")) for line in lines), np.uint64, len(lines)).view(np.int64)


def shared_with(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Numbers of the lines that a page shares with its partner; none if the pages have the same lines."""
    if len(own) == len(other) and (own == other).all():
        return np.empty(0, np.int64)
    return np.flatnonzero(common_lines(own, other))


def content(lines: list[Line], shared: np.ndarray | None) -> str:
    """The text of the lines that are content. Lines that markup calls no content go, plain lines of marked content stay. Of
    the others those stay that the page doesn't share with its partner; without a partner (`shared` is None), all lines of
    a page that marks no content, and none of a page that marks some."""
    gone = set(() if shared is None else shared.tolist())
    marked = any(inside and not out for _, out, inside, _ in lines)
    alone = shared is None and marked
    return " ".join(t for i, (t, out, inside, doubtful) in enumerate(lines) if not out and (inside and not doubtful or not alone and i not in gone))


def host_and_path(url_col: str) -> tuple[Column, Column]:
    """The host in lower case, and the path without scheme, query and fragment; empty for null."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


_KEY = ("page", "th", "host", "path")


def _nearer(path: str, before: str | None, after: str | None) -> int:
    """-1 or 1 for the neighbour whose path shares the longer beginning (the one before if equal), 0 for none."""

    def common(other: str) -> int:
        n = min(len(path), len(other))
        return next((i for i in range(n) if path[i] != other[i]), n)

    if before is None or after is None:
        return -1 if before is not None else 1 if after is not None else 0
    return -1 if common(before) >= common(after) else 1


def _partner(row: tuple, before: tuple | None, after: tuple | None) -> tuple | None:
    """The neighbour in the order with which a row (its first values as in _KEY) is compared; None without one on its host."""
    of_host = lambda r: r if r is not None and r[2] == row[2] else None
    before, after = of_host(before), of_host(after)
    side = _nearer(row[3], before and before[3], after and after[3])
    return None if not side else before if side < 0 else after


def shared_lines(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page, th, partner, shared): for each distinct (id, html) with a partner, the numbers of its shared lines. The
    partner has other lines than the page."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    whole = {"page": "Int64", "partner": "Int64"} if kind in ("bigint", "int") else {}

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[list(_KEY)].assign(hashes=[_hashes(page_lines(h)) for h in batch["html"]])

    def frame(found: list[tuple], edges: list[tuple]) -> pd.DataFrame:
        """found: (row, partner) with hashes; edges: (part, last, at, row)."""
        columns = ["page", "th", "partner", "shared", "part", "last", "at", "host", "path"]
        data = [(a[0], a[1], b[0], shared_with(np.asarray(a[4]), np.asarray(b[4])), None, None, None, None, None) for a, b in found]
        data += [(r[0], r[1], None, None, p, e, i, r[2], r[3]) for p, e, i, r in edges]
        return pd.DataFrame(data, columns=columns).astype({c: "Int64" for c in ("part", "last", "at")} | whole)

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Differences inside a partition; the keys of the two first and two last rows come back for what crosses its borders."""
        part, rows, first, done = None, [], [], 0
        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            for row in zip(*(batch[c] for c in (*_KEY, "hashes"))):
                rows.append(row)
                if done < 2:
                    first.append(row)
                done += 1
            found = [(rows[i], _partner(rows[i], rows[i - 1], rows[i + 1])) for i in range(1, len(rows) - 1)]
            yield frame([x for x in found if x[1]], [])
            rows = rows[-2:]
        if done:
            yield frame([], [(part, 0, i, r) for i, r in enumerate(first)] + [(part, 1, i, r) for i, r in enumerate(rows[-2:])])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shared = [shared_with(np.asarray(a), np.asarray(b)) for a, b in zip(batch["hashes"], batch["others"])]
            yield batch[["page", "th", "partner"]].assign(shared=shared)

    host, path = host_and_path(url_col)
    body = F.coalesce(F.col(html_col), F.lit(""))
    read = pages.select(F.col(id_col).alias("page"), F.xxhash64(body).alias("th"), host.alias("host"), path.alias("path"), body.alias("html"))
    lines = settle(read.mapInPandas(hashed, f"page {kind}, th long, host string, path string, hashes array<long>").withColumn("seq", F.xxhash64("host", "hashes")), "page-lines")
    least = F.min(F.struct("path", "page")).alias("least")
    one = lines.groupBy("seq").agg(least, F.first("host").alias("host"), F.first("hashes").alias("hashes"))
    rows = settle(one.select("least.page", F.col("seq").alias("th"), "host", "least.path", "hashes"), "page-sequences")
    ranged = rows.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "host", "path", "page", "th")
    ranged = ranged.sortWithinPartitions("host", "path", "page", "th").withColumn("part", F.spark_partition_id())
    found = settle(ranged.mapInPandas(pair, f"page {kind}, th long, partner {kind}, shared array<long>, part long, last long, at long, host string, path string"), "page-pairs")
    inside = found.where("part is null").select("page", "th", "partner", "shared")

    edges = found.where("part is not null").select("part", "last", "at", *_KEY).collect()  # at most four keys for each partition
    of_part: dict[int, tuple[list, list]] = {}
    for e in sorted(edges, key=lambda e: (e.part, e.last, e.at)):
        of_part.setdefault(e.part, ([], []))[e.last].append(tuple(e[c] for c in _KEY))
    order, late = [of_part[p] for p in sorted(of_part)], []
    for i, (first, last) in enumerate(order):
        before = order[i - 1][1][-1] if i else None
        after = order[i + 1][0][0] if i + 1 < len(order) else None
        if len(last) == 1:
            late.append((last[0], _partner(last[0], before, after)))
        else:
            late += [(first[0], _partner(first[0], before, first[1])), (last[-1], _partner(last[-1], last[-2], after))]
    across = spark.createDataFrame([(a[0], a[1], b[0], b[1]) for a, b in late if b], f"page {kind}, th long, partner {kind}, pth long")
    few = F.broadcast(across)  # at most two for each partition; only the lines of their sequences meet
    own = settle(rows.select("th", "hashes").join(few, "th"), "border-sequences")
    other = settle(rows.select(F.col("th").alias("pth"), F.col("hashes").alias("others")).join(few.select("pth").distinct(), "pth", "left_semi"), "border-partners")
    across = own.join(other, "pth").mapInPandas(compare, f"page {kind}, th long, partner {kind}, shared array<long>")
    every = settle(inside.unionByName(across).select(F.col("th").alias("seq"), "partner", "shared"), "sequence-pairs")  # a plain scan, so that the join can split a hot sequence
    of_page = settle(lines.groupBy("page", "th").agg(F.min(F.struct("host", "path", "seq")).alias("s")).select("page", "th", "s.seq"), "page-keys")
    return of_page.join(every, "seq").select("page", "th", "partner", "shared")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`id`, `url`, text, n_chars (long), partner (the id of the page it was compared with) and n_shared (long) for each
    row of `pages`.

    Null and empty html give an empty text. Rows with equal id and html are one page: they get equal results and aren't
    partners of each other. A page without another of other lines on its host has no partner and loses nothing to differencing. Null
    urls are of one host without a name. Null ids sort first. Other columns are ignored; an empty table gives an empty
    result. Texts are whole: no block is capped.
    """

    def text_of(html: pd.Series, shared: pd.Series) -> pd.Series:
        return pd.Series([content(page_lines(h), None if s is None else np.asarray(s, np.int64)) for h, s in zip(html, shared)], dtype=object)

    found = settle(shared_lines(pages, id_col, url_col, html_col), "shared-lines")
    body = F.coalesce(F.col(html_col), F.lit(""))
    left = pages.select(F.col(id_col), F.col(url_col), body.alias("_html"), F.xxhash64(body).alias("_th"))
    joined = left.join(found, (F.col("_th") == F.col("th")) & F.col(id_col).eqNullSafe(F.col("page")), "left")
    text = F.pandas_udf(text_of, "string")(F.col("_html"), F.col("shared"))
    n_shared = F.when(F.col("shared").isNull(), 0).otherwise(F.size("shared")).cast("long")
    return joined.select(id_col, url_col, text.alias("text"), "partner", n_shared.alias("n_shared")).select(id_col, url_col, "text", F.length("text").cast("long").alias("n_chars"), "partner", "n_shared")
