"""Pages as trees: a row for each element and each stretch of text, with the elements around it.

The rows come from one pass over a page with a stack of open elements; what they mean is left to plans: sections, labels,
headings and links are found by exploding the elements around a text and joining on their numbers. All keys are (page,
number), so no group is larger than a page.
"""

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.arrays import bound
from corvane.functions.parsers import heading, labelled, left_margin
from corvane.functions.text import squeeze

#: An element around a node.
ELEMENT = "struct<node:int,tag:string,attributes:map<string,string>>"
NODE = f"node int, parent int, depth int, tag string, attributes map<string,string>, text string, path array<{ELEMENT}>"

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that the beginning of others, or of their like, ends.
_ENDED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
#: Within these, an element that is open outside isn't ended.
_WALLS = frozenset("ul ol dl table select section div".split())
_ROWS_AT_ONCE = 20_000


class _Tree(HTMLParser):
    """Rows of pages, and their elements. Text of scripts and styles has those elements around it, like any other.

    Elements are held once; rows and the paths around them name them by their places, so that a page costs what its text and
    its nodes' depths sum up to, without an object for each step of each path."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.clear()
        self.begin(0)

    def clear(self) -> None:
        self.page, self.node, self.parent, self.depth, self.own, self.text = [], [], [], [], [], []
        self.path, self.path_ends = [], [0]
        self.element_node, self.element_tag, self.keys, self.values, self.attribute_ends = [], [], [], [], [0]

    def begin(self, page: int) -> None:
        self.reset()
        self.open: list[tuple[int, str, int]] = []  # node, tag, and the element's place
        self.at, self.number = page, 0

    def _add(self, own: int | None, text: str | None) -> None:
        self.page.append(self.at)
        self.node.append(self.number)
        self.parent.append(self.open[-1][0] if self.open else None)
        self.depth.append(len(self.open))
        self.own.append(own)
        self.text.append(text)
        self.path += [e for _, _, e in self.open]
        self.path_ends.append(len(self.path))
        self.number += 1

    def columns(self) -> list[pa.Array]:
        """The columns of NODE, but for the ids, which `page` is the places of."""
        attributes = pa.MapArray.from_arrays(pa.array(self.attribute_ends, pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        fields = [pa.field("node", pa.int32()), pa.field("tag", pa.string()), pa.field("attributes", attributes.type)]
        elements = pa.StructArray.from_arrays([pa.array(self.element_node, pa.int32()), pa.array(self.element_tag, pa.string()), attributes], fields=fields)
        own = pa.array(self.own, pa.int32())
        path = pa.ListArray.from_arrays(pa.array(self.path_ends, pa.int32()), elements.take(pa.array(self.path, pa.int32())))
        numbers = [pa.array(x, pa.int32()) for x in (self.node, self.parent, self.depth)]
        return [*numbers, elements.field("tag").take(own), attributes.take(own), pa.array(self.text, pa.string()), path]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ended = len(self.open)
        for i in range(len(self.open) - 1, -1, -1):
            if tag in _ENDED_BY.get(self.open[i][1], ()):
                ended = i
            if self.open[i][1] in _WALLS:
                break
        del self.open[ended:]
        attributes: dict[str, str] = {}
        for key, value in attrs:
            attributes.setdefault(key, value or "")
        element, number = len(self.element_node), self.number
        self.element_node.append(number)
        self.element_tag.append(tag)
        self.keys += attributes
        self.values += attributes.values()
        self.attribute_ends.append(len(self.keys))
        self._add(element, None)
        if tag not in _VOID:
            self.open.append((number, tag, element))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][1] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._add(None, data)


def page_nodes(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, node, parent, depth, tag, attributes, text, path) of each element and each text that isn't blank, numbered in page
    order from 0; `path` holds the elements around it, outermost first. Texts have no tag and elements no text. An end tag
    ends all that is open inside its element, and is ignored if nothing matches; of an attribute given twice the first
    counts; comments are left out. Null and empty pages have no rows. Ids are to be unique: what is made of the nodes joins on
    them."""
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["id", *(c.strip().split()[0] for c in "node parent depth tag attributes text path".split())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _Tree()
        for batch in batches:
            ids, pages = batch.column("id"), batch.column("html")
            for i in range(len(pages)):
                tree.begin(i)
                tree.feed(pages[i].as_py())
                tree.close()
                if len(tree.node) > _ROWS_AT_ONCE or i == len(pages) - 1:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(tree.page, pa.int32())), *tree.columns()], names)
                    tree.clear()

    some = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where("html <> ''")
    return some.mapInArrow(read, f"id {kind}, {NODE}").withColumnRenamed("id", id_col)


def classes(element: Column) -> Column:
    return F.split(F.btrim(F.coalesce(element["attributes"]["class"], F.lit(""))), r"\s+")


def inside(path: Column, test: Callable[[Column], Column]) -> Column:
    """Whether an element of the path passes a test."""
    return F.exists(path, lambda e: F.coalesce(test(e), F.lit(False)))


def beneath(path: Column, test: Callable[[Column], Column]) -> Column:
    """The part of a path inside its first element that passes a test; empty if none does."""
    marks = F.transform(path, lambda e: F.coalesce(test(e), F.lit(False)))
    behind = lambda at: F.when(at > 0, F.slice(path, at + 1, F.size(path))).otherwise(F.slice(path, 1, 0))
    return bound(F.array_position(marks, F.lit(True)).cast("int"), behind)


def texts_within(nodes: DataFrame, id_col: str, chosen: Column, shown: Column | None = None) -> DataFrame:
    """(id, node, tag, attributes, path, text) of elements: the whole text in each, in page order, white space as one space.
    `chosen` gives, for a text, those elements of its path that are asked for; `shown` says which texts count. Elements
    without a text that counts have no row."""
    said = nodes.where(F.col("tag").isNull() & (F.lit(True) if shown is None else shown))
    each = said.select(id_col, F.col("node").alias("_at"), "text", "path", F.explode(chosen).alias("_e"))
    before = F.filter("path", lambda e: e["node"] < F.col("_e.node"))
    grouped = each.groupBy(id_col, F.col("_e.node").alias("node")).agg(
        F.first("_e.tag").alias("tag"), F.first("_e.attributes").alias("attributes"), F.first(before).alias("path"), F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("_t")
    )
    return grouped.select(id_col, "node", "tag", "attributes", "path", squeeze(F.array_join(F.transform("_t", lambda t: t["text"]), " ")).alias("text"))


# The element that holds a law page's text, the headings in it, and the class of repeated links.
LAW_BODY, LAW_HEADINGS, REPEATED_LINK = "leaf-statute-body", ("h2", "h3", "h4", "h5", "h6"), "pedantic"
_UNSEEN = ("script", "style", "noscript", "template")


def _label(text: Column) -> Column:
    """What a heading "(a)" or "2.1." names; null for other headings."""
    lettered = F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")")) & ~F.contains(F.substr(text, F.lit(2)), F.lit("(")) & (F.length(text) > 2)
    bare = F.rtrim(text, F.lit("."))
    numbered = (F.translate(bare, "0123456789.", "") == "") & ~F.contains(bare, F.lit("..")) & ~F.startswith(bare, F.lit(".")) & (bare != "") & (F.length(text) - F.length(bare) <= 1)
    return F.when(lettered, F.regexp_replace(text, r"^\(|\)$", "")).when(numbered, bare)


def law_sections(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, place, label, text, level, history): the sections of law pages, those inside others too, in page order.

    A section's text is all text in it, also that of sections inside, but for headings and repeated links. Its label is its
    first heading, if that is a letter in brackets or a number; its level is in its class, else 0. Sections of class
    meta (and not non-meta) aren't sections of the law: the last with a text is the page's history. A page without
    sections is one of level 0, up to "Source:". Pages without the body's element have no rows.
    """
    body = lambda e: e["attributes"]["id"] == LAW_BODY
    meta = lambda e: F.contains(e["attributes"]["class"], F.lit("meta")) & bound(classes(e), lambda c: F.array_contains(c, "meta") & ~F.array_contains(c, "non-meta"))
    hides = lambda e: e["tag"].isin(*LAW_HEADINGS) | ((e["tag"] == "a") & F.array_contains(classes(e), REPEATED_LINK))
    path = F.col("path")
    sections = F.filter(beneath(path, body), lambda e: e["tag"] == "section")
    plain, notes = F.filter(sections, lambda e: ~F.coalesce(meta(e), F.lit(False))), F.filter(sections, meta)
    seen = ~inside(path, lambda e: e["tag"].isin(*_UNSEEN))
    level = F.coalesce(F.regexp_extract(F.array_join(classes(F.struct("attributes")), " "), r"level-(\d+)", 1).try_cast("double"), F.lit(0.0))
    parts = texts_within(nodes, id_col, plain, seen & ~inside(path, hides)).select(id_col, "node", level.alias("level"), "text").where("text <> ''")
    heads = texts_within(nodes, id_col, F.filter(path, lambda e: e["tag"].isin(*LAW_HEADINGS)), seen)
    of_section = heads.select(id_col, "node", "text", F.explode(F.filter("path", lambda e: e["tag"] == "section")).alias("_s"))
    first = of_section.groupBy(id_col, F.col("_s.node").alias("node")).agg(F.min_by("text", "node").alias("_h"))
    labelled = parts.join(first, [id_col, "node"], "left").select(id_col, "node", _label(F.col("_h")).alias("label"), "text", "level")
    history = texts_within(nodes, id_col, notes, seen).where("text <> ''").groupBy(id_col).agg(F.max_by("text", "node").alias("history"))
    whole = texts_within(nodes, id_col, F.slice(F.filter(path, body), 1, 1), seen)
    until = F.when(F.instr("text", "Source:") > 1, F.rtrim(F.substring_index("text", "Source:", 1))).otherwise(F.col("text"))
    lone = whole.join(labelled.select(id_col), id_col, "left_anti").select(id_col, "node", F.lit(None).cast("string").alias("label"), until.alias("text"), F.lit(0.0).alias("level"))
    numbered = labelled.unionByName(lone).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("node", "label", "text", "level"))).alias("_s"))
    placed = numbered.select(id_col, F.posexplode("_s").alias("place", "_s")).select(id_col, "place", "_s.label", "_s.text", "_s.level")
    return placed.join(history, id_col, "left")


# The element that holds a code page's text, and the tag of the body in it.
CODE_CONTENT, CODE_BODY = "codeLawSectionNoHead", "font"


def code_pages(nodes: DataFrame, id_col: str) -> DataFrame:
    """One row per code page that has its content's element: the code's name, `hierarchy` (level to ident, title and range), the
    section's number, `paragraphs` (label, text, depth in em) and the history note.

    Headings (h4, h5) outside the body count: the first is the code's name, without its abbreviation; of two of one level
    the last counts; those that name no level are passed over. The number is that of the body's first h6; paragraphs are
    all of the body's in page order, a label peeled off each; the last text in italics is the history. Where there is no
    body element, the whole content is the body.
    """
    content = lambda e: e["attributes"]["id"] == CODE_CONTENT
    font = lambda e: e["tag"] == CODE_BODY
    within = beneath(F.col("path"), content)
    held = nodes.where(inside(F.col("path"), content)).withColumn("path", within)
    chosen = F.filter("path", lambda e: e["tag"].isin("h4", "h5", "h6", "p", "i"))
    found = texts_within(held, id_col, chosen, ~inside(F.col("path"), lambda e: e["tag"].isin(*_UNSEEN))).where("text <> ''")
    margin = left_margin(F.coalesce(F.col("attributes")["style"], F.lit("")))
    rows = found.select(id_col, F.struct("node", "tag", "text", margin.alias("depth"), inside(F.col("path"), font).alias("inner")).alias("e"))
    fonts = held.where(font(F.struct("tag"))).select(id_col).distinct().withColumn("_font", F.lit(True))
    pages = rows.groupBy(id_col).agg(F.array_sort(F.collect_list("e")).alias("e")).join(fonts, id_col, "left")
    has_body = F.coalesce("_font", F.lit(False))
    own = lambda *tags: F.filter("e", lambda e: e["tag"].isin(*tags) & (e["inner"] | ~has_body))
    outer = F.filter("e", lambda e: e["tag"].isin("h4", "h5") & ~e["inner"])
    heads = F.filter(F.transform(F.slice(outer, 2, F.size(outer)), lambda e: heading(e["text"])), lambda h: h["level"].isNotNull())
    # of equal levels the last one: reversed, the first
    levels = F.transform(F.array_distinct(F.transform(heads, lambda h: h["level"])), lambda k: F.struct(k.alias("key"), F.get(F.reverse(F.filter(heads, lambda h: h["level"] == k)), F.lit(0)).alias("h")))
    hierarchy = F.map_from_entries(F.transform(levels, lambda x: F.struct(x["key"], F.struct(x["h"]["ident"].alias("ident"), x["h"]["title"].alias("title"), x["h"]["range"].alias("range")))))
    banner = F.get(outer, F.lit(0))["text"]
    short = F.substring_index(banner, " - ", -1)
    abbreviated = (short != banner) & (short == F.upper(short)) & (F.length(short) <= 6) & short.rlike("[A-Z]")
    number = F.rtrim(F.get(own("h6"), F.lit(0))["text"], F.lit(". "))
    paragraphs = F.transform(own("p"), lambda p: bound(labelled(p["text"]), lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"), p["depth"].alias("depth"))))
    return pages.select(
        id_col, F.when(abbreviated, F.left(banner, F.length(banner) - F.length(short) - 3)).otherwise(banner).alias("code_name"), hierarchy.alias("hierarchy"),
        F.when(number.rlike(r"^[0-9]+([.][0-9]+)?[A-Za-z]?$"), number).alias("section"), paragraphs.alias("paragraphs"), F.get(F.reverse(own("i")), F.lit(0))["text"].alias("history"),
    )
