"""Sources of law and the links of their tables of contents: what a link leads to is read from its path or its query."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.arrays import bound, first_of_each
from corvane.functions.citations import behind
from corvane.functions.parsers import heading, listed_rows
from corvane.functions.text import common_references, squeeze


@dataclass(frozen=True)
class Source:
    """How one jurisdiction's code is listed and checked."""

    jurisdiction: str
    law_code: str
    #: What the last part of a link's path begins with; empty where links carry a query instead.
    prefix: str
    #: What the numbers of sections begin with, below the page of a number.
    nested: str = ""
    #: Whether pages list their parts as plain rows, without links.
    rows: bool = False
    #: What a fetched section page has.
    marker: str = "leaf-statute-body"
    least_bytes: int = 2000


# The sources by name, with the forms of their links.
SOURCES = {
    "ca_leginfo_pages": Source("CA", "VEH", "", marker="var lawCode", least_bytes=0),
    "ny_public_law": Source("NY", "VAT", "n.y._vehicle_and_traffic_law_", rows=True),
    "tx_public_law": Source("TX", "TN", "tex._transp._code_"),
    "co_public_law": Source("CO", "CRS42", "crs_", nested="42-{}-"),
    "fl_public_law": Source("FL", "TXX", "fla._stat._"),
    "nv_public_law": Source("NV", "NRS43", "nrs_", nested="{}."),
    "or_public_law": Source("OR", "ORS59", "ors_"),
}
# Levels that a path names, outermost first, and those whose numbers are unique only within the level above.
LEVELS, SCOPED = ("title", "subtitle", "article", "chapter", "sub-chapter", "section"), ("subtitle", "sub-chapter")
# Pages and calls of the source whose links carry a query.
BRANCH_PAGE, TEXT_PAGE, SECTION_CALL = "codes_displayexpandedbranch", "codes_displaytext", "submitcodesvalues("
LINK = "struct<kind:string,number:string,key:string>"


def _link(kind: Column, number: Column, key: Column) -> Column:
    return F.struct(kind.alias("kind"), number.alias("number"), key.alias("key"))


def path_link(url: Column, source: Source) -> Column:
    """struct(kind, number, key) of a link by the last part of its path, "<prefix>chapter_545" or "<prefix>545.351"; null for other
    links. Escaped underscores are undone; a path that names no level is a section's."""
    last = F.substring_index(F.split_part(F.split_part(F.lower(url), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), "/", -1)
    plain = F.replace(last, F.lit("%5f"), F.lit("_"))

    def named(marked: Column) -> Column:
        levels = [F.when(F.contains(marked, F.lit(f"_{k}_")), F.struct(F.lit(k).alias("kind"), F.rtrim(F.substring_index(marked, f"_{k}_", -1), F.lit(".")).alias("number"))) for k in reversed(LEVELS)]
        return F.coalesce(*levels, F.struct(F.lit("section").alias("kind"), F.rtrim(F.substr(marked, F.lit(2)), F.lit(".")).alias("number")))

    def link(rest: Column) -> Column:
        def read(n: Column) -> Column:
            scoped = n["kind"].isin(*SCOPED)
            right = F.when(scoped, n["number"] != "").otherwise(n["number"].rlike("^[0-9]") & ~F.contains(n["number"], F.lit("_")))
            return F.when(right, _link(n["kind"], n["number"], F.when(scoped, rest).otherwise(F.concat_ws("_", n["kind"], n["number"]))))

        return bound(bound(F.concat(F.lit("_"), rest), named), read)

    return bound(plain, lambda p: F.when(F.startswith(p, F.lit(source.prefix)), bound(F.substr(p, F.lit(len(source.prefix) + 1)), link)))


def query_link(url: Column, source: Source) -> Column:
    """The same for links whose query names a division, the parts of a text page, or a call with a section's number."""

    def of_query(plain: Column, given: Column) -> Column:
        part = lambda name: F.nullif(F.rtrim(given[name], F.lit(".")), F.lit(""))
        own = (F.coalesce(given["toccode"], given["lawcode"]) == source.law_code.lower()) & part("division").isNotNull()
        place = F.concat_ws("_", *(part(p) for p in ("division", "title", "part", "chapter", "article")))
        return F.when(own & F.contains(plain, F.lit(BRANCH_PAGE)), _link(F.lit("division"), part("division"), F.concat(F.lit("division_"), part("division")))).when(
            own & F.contains(plain, F.lit(TEXT_PAGE)), bound(place, lambda p: _link(F.lit("text"), p, F.concat(F.lit("text_"), p)))
        )

    def read(plain: Column) -> Column:
        called = F.rtrim(F.split_part(behind(plain, f"{SECTION_CALL}'"), F.lit("'"), F.lit(1)), F.lit("."))
        given = F.str_to_map(F.coalesce(behind(plain, "?"), F.lit("")), F.lit("&"), F.lit("="))
        return bound(called, lambda c: F.when(c.rlike("^[0-9]"), _link(F.lit("section"), c, F.concat(F.lit("section_"), c))).otherwise(bound(given, lambda g: of_query(plain, g))))

    return bound(F.replace(F.lower(url), F.lit("&amp;"), F.lit("&")), read)


def link_of(url: Column, source: Source) -> Column:
    return path_link(url, source) if source.prefix else query_link(url, source)


def _anchors(page: Column) -> Column:
    """What follows the name of each anchor's tag, up to the next anchor."""
    return F.slice(F.split(page, r"(?i)<a(?=\s)"), 2, F.lit(1 << 30))


def _anchor_link(piece: Column, source: Source) -> Column:
    href = F.regexp_extract(F.substring_index(piece, ">", 1), r"""(?is)href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return link_of(F.btrim(href, F.lit("\"'")), source)


def page_links(page: Column, source: Source) -> Column:
    """array of struct(link, title) of the anchors of a page that lead into the source, in page order; the title is the
    anchor's text."""

    def one(piece: Column) -> Column:
        ended = F.split(F.regexp_replace(piece, "^[^>]*>", ""), r"(?i)</a\s*>", 2)
        plain = lambda t: bound(squeeze(common_references(F.regexp_replace(t, r"<[^>]*>", " "))), lambda s: F.when(s != "", s))
        return F.struct(_anchor_link(piece, source).alias("link"), bound(ended, lambda e: F.when(F.size(e) > 1, plain(F.get(e, F.lit(0))))).alias("title"))

    return F.filter(F.transform(_anchors(page), one), lambda x: x["link"].isNotNull())


def toc_sections(page: Column, source: Source) -> Column:
    """The distinct section numbers that a table of contents links to, in page order."""
    found = F.filter(F.transform(_anchors(page), lambda piece: _anchor_link(piece, source)), lambda x: x["kind"] == "section")
    return F.array_distinct(F.transform(found, lambda x: x["number"]))


def captioned_rows(page: Column, begin: str, end: str) -> Column:
    """array of struct(number, title) of the rows of a plain list like "1 Words and phrases Sections 100-161 2 Administration
    Sections 200-217", between two words of the page: a number with the words behind it, up to Section or Sections. A number
    of more than three digits must begin its row, as a caption may hold a year. Of equal numbers the first counts."""
    plain = F.regexp_replace(F.regexp_replace(page, r"<[^>]*>", " "), r"\s+", " ")
    held = F.concat(F.lit(" "), F.coalesce(F.split_part(behind(plain, f"{begin} "), F.lit(f" {end}"), F.lit(1)), F.lit("")))
    chunks = F.split(F.translate(held, "‑–—", "---"), " Sections? ")
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")

    def row(w: Column) -> Column:
        digits = F.transform(w, lambda x: x.rlike("[0-9]"))
        last = F.size(w) - F.array_position(F.reverse(digits), F.lit(True)).cast("int")  # the last word with a digit, from 0
        begins = lambda at: (at == 0) | F.get(digits, at - 1)
        number = lambda at, n: F.when(n.rlike("^[0-9]{1,3}(-[A-Z])?$") | (begins(at) & n.rlike("^[0-9]+(-[A-Z])?$")), n)
        return bound(last, lambda at: F.struct(number(at, F.get(w, at)).alias("number"), F.array_join(F.slice(w, at + 2, F.lit(1 << 30)), " ").alias("title")))

    rows = F.transform(bound(chunks, lambda c: F.slice(c, 1, F.size(c) - 1)), lambda chunk: bound(words(chunk), row))
    return first_of_each(F.filter(rows, lambda r: r["number"].isNotNull() & r["title"].rlike("^[A-Z]")), "number")


def valid_page(page: Column, source: Source) -> Column:
    return (F.octet_length(page) >= source.least_bytes) & F.contains(page, F.lit(source.marker))


#: What a page of rows lists, by its own kind: the rows' kind, and the word that begins the list.
_ROWS = {"root": ("title", "Titles"), "title": ("article", "Articles"), "article": ("section", "Sections")}
_END = "Stay Connected"


def contents_links(page: Column, own: Column, source: Source) -> Column:
    """array of struct(kind, number, key, title) that a page of contents leads to, each key once, in page order. `own` is the
    page's own link struct, null for the first page. Sections that don't belong below the page's number are left out."""
    def item(kind: str, number: Column, title: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), number.alias("number"), F.concat_ws("_", F.lit(kind), F.lower(number)).alias("key"), title.alias("title"))

    def listed(kind: str, word: str) -> Column:
        if kind == "section":
            return F.transform(listed_rows(page, word, _END), lambda n: item(kind, n, F.lit(None).cast("string")))
        return F.transform(captioned_rows(page, word, _END), lambda r: item(kind, r["number"], r["title"]))

    if source.rows:
        mine = F.coalesce(own["kind"], F.lit("root"))
        return F.coalesce(*(F.when(mine == kind, listed(*below)) for kind, below in _ROWS.items()))
    short = lambda t: F.coalesce(heading(t)["title"], t)
    linked = F.transform(page_links(page, source), lambda x: F.struct(x["link"]["kind"].alias("kind"), x["link"]["number"].alias("number"), x["link"]["key"].alias("key"), short(x["title"]).alias("title")))
    if source.nested:
        before, after = source.nested.split("{}")
        number = F.substring_index(F.regexp_replace(own["key"], "_sub-chapter_.*$", ""), "_", -1)
        every = linked
        below = lambda begins: F.filter(every, lambda x: (x["kind"] != "section") | F.coalesce(F.startswith(x["number"], begins), F.lit(False)))
        linked = bound(F.concat(F.lit(before), number, F.lit(after)), below)
    return first_of_each(linked, "key")


# How the numbers of sections are built, by jurisdiction: what parts their numbers, and whether the last part may be missing.
NUMBER_PARTS = {"CA": ((".",), True), "TX": ((".",), False), "FL": ((".",), False), "OR": ((".",), False), "NV": ((".",), False), "CO": (("-", "-", "."), True), "NY": (("-",), True)}


def section_order(section: Column, source: Source) -> Column:
    """The sort key of a source's section number: its numbers in turn, a letter behind the first one where the source has such,
    and the text itself. Numbers that aren't built as the source builds them come last."""
    parts, optional = NUMBER_PARTS[source.jurisdiction]
    s = F.lower(F.trim(section))
    tokens = F.regexp_extract_all(s, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    at = lambda i: F.get(tokens, F.lit(i))
    lettered = at(1).rlike(r"^[a-z]\.$") if source.jurisdiction == "NV" else F.lit(False)
    numbers, right = [at(0).try_cast("long")], at(0).rlike("^[0-9]+$")
    for i, part in enumerate(parts):
        there = (at(2 * i + 1) == part) | (lettered if i == 0 else F.lit(False))
        number = F.when(there, at(2 * i + 2).try_cast("long"))
        numbers.append(number)
        if not (optional and i == len(parts) - 1):
            right = right & F.coalesce(number.isNotNull(), F.lit(False))
    last, right = F.lit(10**9).cast("long"), F.coalesce(right, F.lit(False))
    keys = [F.when(right, F.coalesce(n, F.lit(0).cast("long"))).otherwise(last).alias(f"n{i}") for i, n in enumerate(numbers)]
    letter = F.when(right & lettered, F.left(at(1), F.lit(1))).otherwise("").alias("letter")
    return F.struct(keys[0], letter, *keys[1:], s.alias("text"))
