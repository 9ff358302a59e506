"""Parser queries over generated pages, instructions and replies."""

from pyspark.sql import functions as F

from corvane.functions import contents, parsers
from corvane.functions.text import base_section
from corvane.operators.page_tables import tables_in_pages
from corvane.operators.ranking import first_per
from corvane.operators.validation import Shape, checked
from corvane.operators.walks import walk
from corvane.plans.catalog import query, spread, table
from corvane.session import settle, shared_path


def _i():
    return F.col("p_partkey")


def _n():
    return F.col("p_size")


@query("instruction_parts", """
SELECT p_partkey, p_partkey::VARCHAR AS number, 'Turning ' || p_size AS title, 'Body ' || p_name AS instruction_text, 'Use ' || p_brand AS directions_for_use,
       '• Penal Code section ' || p_size || chr(10) || '• see Veh. Code, § ' || p_size || '(a)' AS sources_and_authority, '' AS secondary_sources, 2 AS n_bullets, 'see Veh. Code, § ' || p_size || '(a)' AS context
FROM part
""")  # fmt: skip
def instruction_parts(spark, folder):
    made = F.concat(
        F.lit("Body "), "p_name", F.lit("\nNew September 2003; Revised May 2020\n\nDirections for Use\nUse "), "p_brand",
        F.lit("\n\n  Sources and Authority  \n• Penal Code section "), _n(), F.lit("\n• see Veh. Code, § "), _n(), F.lit("(a)\n"),
    )
    title = parsers.instruction_title(F.concat(_i(), F.lit(".  Turning "), _n(), F.lit(" ")))
    rows = table(spark, folder, "part").select(_i(), title.alias("t"), parsers.instruction_parts(made).alias("p"), _n())
    found = parsers.bullets(F.col("p.sources_and_authority"))
    return rows.select("p_partkey", "t.*", "p.*", F.size(found).alias("n_bullets"), parsers.citing_bullet(found, F.lit("VEH"), _n().cast("string")).alias("context"))


@query("script_metadata", """
SELECT p_partkey, 'VEH' AS law_code, p_partkey::VARCHAR AS section_num, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS op_chapter, '15.' || p_size AS node_tree_path FROM part
""")  # fmt: skip
def script_metadata(spark, folder):
    chapter = F.when(_n() % 2 == 0, _n().cast("string")).otherwise("")
    page = F.concat(F.lit("<script>var lawCode = 'VEH'; var sectionNum='"), _i(), F.lit("';\nvar op_chapter = '"), chapter, F.lit("';</script><a onclick=\"{'nodeTreePath' : '15."), _n(), F.lit("'}\">"))
    return table(spark, folder, "part").select(_i(), parsers.script_metadata(page).alias("m")).select("p_partkey", "m.law_code", "m.section_num", "m.op_chapter", "m.node_tree_path")


@query("hierarchy_headings", """
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'chapter' END AS level, CASE WHEN p_partkey % 3 < 2 THEN p_size || '.5' END AS ident, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS title,
       CASE WHEN p_partkey % 3 = 0 THEN p_size || ' - ' || p_partkey END AS range
FROM part
""")  # fmt: skip
def hierarchy_headings(spark, folder):
    text = F.concat(F.when(_i() % 3 < 2, "CHAPTER ").otherwise("FOOTNOTE "), _n(), F.lit(".5. "), "p_name", F.when(_i() % 3 == 0, F.concat(F.lit(" [ "), _n(), F.lit(" - "), _i(), F.lit(" ] "))).otherwise(""))
    return table(spark, folder, "part").select(_i(), parsers.heading(text).alias("h")).select("p_partkey", "h.*")


@query("html_sections", """
SELECT p_partkey, k::INT AS place, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'a' ELSE '1' END AS label, CASE k WHEN 0 THEN 'Intro ' || p_name WHEN 1 THEN '(1) A & b' ELSE p_brand END AS text, CASE k WHEN 2 THEN 2.5 ELSE 0 END::DOUBLE AS depth
FROM part, (SELECT unnest([0, 1, 2]) AS k)
""")  # fmt: skip
def html_sections(spark, folder):
    page = F.concat(F.lit("<div><p>Intro <b>"), "p_name", F.lit("</b></p><p>\n(a) (1) A & b</p><p></p><p style=\"margin-left: 2.5em;\">(1)  "), "p_brand", F.lit("</p></div>"))
    rows = spread(table(spark, folder, "part")).select(_i(), F.posexplode(parsers.subsections(page)).alias("place", "s"))
    return rows.select("p_partkey", "place", "s.*")


@query("page_facts", """
SELECT p_partkey, p_partkey || '.' || p_size AS number, p_name AS name, 'Transp. Code' AS code_name, 'https://x/' || p_partkey AS url, '2023-01-05' AS last_modified, p_size::VARCHAR AS chapter, p_brand AS chapter_title FROM part
""")  # fmt: skip
def page_facts(spark, folder):
    page = F.concat(
        F.lit('<head><link rel="canonical" href="https://x/'), _i(), F.lit('"></head><body class="c"><span class="a meta-name-and-number">Tex. Transp. Code <b>Section '), _i(), F.lit("."), _n(), F.lit('</b></span><span id="name"> '), "p_name",
        F.lit('</span><script type="application/ld+json">{"@type": "BreadcrumbList", "itemListElement": [{"name": "Home"}, {"name": "Chap. '), _n(), F.lit(". "), "p_brand",
        F.lit('"}]}</script><p class="card-text"><strong>Last modified: </strong> Jan. 5, 2023</p></body>'),
    )
    rows = spread(table(spark, folder, "part")).select(_i(), parsers.page_facts(page).alias("f"), parsers.breadcrumbs(page)["chapter"].alias("c"))
    return rows.select("p_partkey", "f.number", "f.name", "f.code_name", "f.url", "f.last_modified", F.col("c.ident").alias("chapter"), F.col("c.title").alias("chapter_title"))


@query("acts_history", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Amended' ELSE 'Enacted' END AS action, year(o_orderdate)::INT AS statutes_year, o_custkey::VARCHAR AS chapter, '19.' || o_orderkey AS section, strftime(o_orderdate, '%Y-%m-%d') AS effective_date FROM orders
""")  # fmt: skip
def acts_history(spark, folder):
    note = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Amended by ").otherwise(""), F.lit("Acts "), F.year("o_orderdate"), F.lit(", 74th Leg., ch. "), "o_custkey", F.lit(", Sec. 19."), "o_orderkey", F.lit(", eff. "), F.date_format("o_orderdate", "MMM'.' d, yyyy"), F.lit("."))
    return table(spark, folder, "orders").select("o_orderkey", parsers.acts_history(note).alias("h")).select("o_orderkey", "h.action", "h.statutes_year", "h.chapter", "h.section", "h.effective_date")


@query("toc_by_source", "SELECT p_partkey, p_size || '.' || p_partkey AS tx, '42-' || p_size || '-' || p_partkey AS co FROM part")
def toc_by_source(spark, folder):
    page = F.concat(F.lit('<a href="/tex._transp._code%5Fsection_'), _n(), F.lit("."), _i(), F.lit('">x</a><a href="/tex._transp._code_section_'), _n(), F.lit("."), _i(), F.lit('">y</a><a href="/crs_42-'), _n(), F.lit("-"), _i(), F.lit('">'))
    listed = {k: F.array_join(contents.toc_sections(page, contents.SOURCES[s]), ",") for k, s in (("tx", "tx_public_law"), ("co", "co_public_law"))}
    return spread(table(spark, folder, "part")).select(_i(), *(v.alias(k) for k, v in listed.items()))


@query("eval_lists", "SELECT p_partkey, p_partkey::VARCHAR AS section, 'CA/VEH/' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '/a' ELSE '' END AS key, 'https://x?lawCode=VEH&sectionNum=' || p_partkey AS url FROM part")
def eval_lists(spark, folder):
    sub = F.when(_n() % 2 == 0, "(a)").otherwise("")
    cell, cited = F.concat(_i(), F.lit(" "), sub, F.lit(" & (b)")), F.concat(F.lit("see Cal. Veh. Code § "), _i(), sub)
    return table(spark, folder, "part").select(_i(), parsers.listed_section(cell).alias("section"), parsers.listed_citation(cited).alias("key"), parsers.section_url("https://x", F.lit("VEH"), _i().cast("string")).alias("url"))


@query("reply_citations", """
WITH c AS (SELECT p_partkey, unnest([{'j': 'CA', 's': p_partkey || '(a)'}, {'j': 'CA', 's': p_size::VARCHAR}, {'j': NULL, 's': '7'}]) AS x FROM part)
SELECT p_partkey, x.j AS jurisdiction, x.s AS section FROM c
""")  # fmt: skip
def reply_citations(spark, folder):
    reply = F.concat(F.lit("Under Cal. Veh. Code §§ "), _i(), F.lit("(a), "), _n(), F.lit(" you must stop."), F.repeat(F.lit(" and so on"), 20), F.lit(" See § 7."))
    return table(spark, folder, "part").select(_i(), F.inline(parsers.reply_citations(reply)))


@query("cited_statutes", """
WITH c AS (SELECT doc_id % 50 AS reply, doc_id::VARCHAR AS section, CASE WHEN doc_id % 2 = 0 THEN 'en' END AS lang FROM documents)
SELECT DISTINCT c.reply, d.doc_id FROM c JOIN documents d ON d.doc_id::VARCHAR = c.section AND (c.lang = d.lang OR c.lang IS NULL AND d.lang IN ('de', 'fr'))
""")  # fmt: skip
def cited_statutes(spark, folder):
    """Citations joined with statutes on the base section: in the jurisdiction named, else in those of the conversation."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    cites = docs.select((F.col("doc_id") % 50).alias("reply"), F.concat(F.col("doc_id"), F.lit("(a)")).alias("section"), F.when(F.col("doc_id") % 2 == 0, "en").alias("named"))
    context = F.array(F.lit("de"), F.lit("fr"))
    joined = cites.withColumn("base", base_section(F.col("section"))).join(docs.withColumn("base", F.col("doc_id").cast("string")), "base")
    right = F.when(F.col("named").isNotNull(), F.col("named") == F.col("lang")).when(F.size(context) > 0, F.array_contains(context, F.col("lang"))).otherwise(True)
    return joined.where(right).select("reply", "doc_id").distinct()


@query("jurisdiction_mentions", r"""
WITH t AS (SELECT conv_id, turn, ' ' || regexp_replace(replace(lower(text || CASE turn % 3 WHEN 0 THEN ' in California' WHEN 1 THEN ' New York or Texas' ELSE ' here' END), '.', ''), '[^a-z0-9]+', ' ', 'g') AS t FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter([
  CASE WHEN regexp_matches(t, ' (california|calif|cal veh)') THEN 'CA' END, CASE WHEN regexp_matches(t, ' (new york|n ?y (veh|vat)|vehicle and traffic law)') THEN 'NY' END,
  CASE WHEN regexp_matches(t, ' (texas|tex transp|transportation code)') THEN 'TX' END], lambda x: x IS NOT NULL), ',') AS mentioned
FROM t
""")  # fmt: skip
def jurisdiction_mentions(spark, folder):
    k = F.col("turn") % 3
    said = F.concat("text", F.when(k == 0, " in California").when(k == 1, " New York or Texas").otherwise(" here"))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(parsers.mentioned(said), ",").alias("mentioned"))


@query("first_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) = 1")
def first_turns(spark, folder):
    return first_per(table(spark, folder, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


@query("safe_filenames", "SELECT p_partkey, upper('a_' || p_size || '_' || p_partkey) AS name FROM part")
def safe_filenames(spark, folder):
    return table(spark, folder, "part").select(_i(), parsers.safe_filename(F.concat(F.lit(" a/"), _n(), F.lit(" "), _i())).alias("name"))


#: Chapters c of twenty suppliers s each, in five titles t, as edges of each source's contents: what a page of one level lists.
_CONTENTS = """
WITH RECURSIVE s AS (SELECT s_suppkey AS s, s_suppkey // 20 + 10 AS c, (s_suppkey // 20) % 5 + 1 AS t, chr((97 + s_suppkey // 20 % 3)::INT) AS u FROM supplier), e AS (
  SELECT DISTINCT 'CA' AS source, 'root' AS pk, '' AS p, 'division' AS kind, t::VARCHAR AS n FROM s
  UNION SELECT 'CA', 'division', t::VARCHAR, 'text', t || '_' || c FROM s UNION SELECT 'CA', 'text', t || '_' || c, 'section', c || '.' || s FROM s
  UNION SELECT 'NY', 'root', '', 'title', t::VARCHAR FROM s UNION SELECT 'NY', 'title', t::VARCHAR, 'article', c::VARCHAR FROM s
  UNION SELECT 'NY', 'article', c::VARCHAR, 'section', (s % 9000 + 1000) || '-' || chr((65 + s // 9000)::INT) FROM s
  UNION SELECT 'TX', 'root', '', 'title', t::VARCHAR FROM s UNION SELECT 'TX', 'title', t::VARCHAR, 'subtitle', t || u FROM s
  UNION SELECT 'TX', 'subtitle', t || u, 'chapter', c::VARCHAR FROM s UNION SELECT 'TX', 'chapter', c::VARCHAR, 'section', c || '.' || s FROM s
  UNION SELECT 'CO', 'root', '', 'article', c::VARCHAR FROM s UNION SELECT 'CO', 'article', c::VARCHAR, 'section', '42-' || c || '-' || s FROM s
  UNION SELECT 'FL', 'root', '', 'chapter', c::VARCHAR FROM s UNION SELECT 'FL', 'chapter', c::VARCHAR, 'section', c || '.' || s FROM s
  UNION SELECT 'NV', 'root', '', 'chapter', c || u FROM s UNION SELECT 'NV', 'chapter', c || u, 'sub-chapter', 'part_of_' || c FROM s
  UNION SELECT 'NV', 'sub-chapter', 'part_of_' || c, 'section', c || u || '.' || s FROM s
  UNION SELECT 'OR', 'root', '', 'chapter', c::VARCHAR FROM s UNION SELECT 'OR', 'chapter', c::VARCHAR, 'section', c || '.' || s FROM s
), w AS (
  SELECT DISTINCT source, pk AS kind, p AS number, 0 AS depth, NULL::VARCHAR AS parent FROM e WHERE pk = 'root'
  UNION SELECT e.source, e.kind, e.n, w.depth + 1, w.number FROM e JOIN w ON w.source = e.source AND w.kind = e.pk AND w.number = e.p
)
SELECT source, kind, number, depth, parent FROM w
"""


def _contents_pages(spark, folder):
    """(source, key, html): pages of contents, one for the root and one for each part that has parts, as each source writes
    them, with links that lead elsewhere."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("s"))
    c0 = F.floor(F.col("s") / 20)
    s = s.withColumns({"c": c0 + 10, "t": c0 % 5 + 1, "u": F.char((97 + c0 % 3).cast("int"))})
    a = lambda *path: F.concat(F.lit("<li><a class=x href='"), *(F.lit(p) if isinstance(p, str) and len(p) > 1 else F.col(p) for p in path), F.lit("'>Part <b>one</b></a>"))
    row = lambda n, word: F.concat(F.lit(" "), n, F.lit(" Some rules Sections 1-9" if word else " Some rules"))
    tc = F.concat_ws("_", "t", "c")
    edges = [
        ("CA", F.lit("root"), a("/faces/codes_displayexpandedbranch.xhtml?tocCode=VEH&amp;division=", "t", ".&amp;title=&amp;part=&amp;chapter=&amp;article=&amp;nodetreepath=1")),
        ("CA", F.concat_ws("_", F.lit("division"), "t"), a("/faces/codes_displayText.xhtml?lawCode=VEH&division=", "t", ".&title=&part=&chapter=", "c", ".&article=")),
        ("CA", F.concat_ws("_", F.lit("text"), tc), F.concat(F.lit('<a href="javascript:submitCodesValues(\''), "c", F.lit("."), "s", F.lit(".','1.2')\">x</a>"))),
        ("NY", F.lit("root"), row(F.col("t"), True)), ("NY", F.concat_ws("_", F.lit("title"), "t"), row(F.col("c"), True)),
        ("NY", F.concat_ws("_", F.lit("article"), "c"), row(F.concat(F.col("s") % 9000 + 1000, F.lit("-"), F.char((65 + F.floor(F.col("s") / 9000)).cast("int"))), False)),
        ("TX", F.lit("root"), a("/statutes/tex._transp._code%5Ftitle%5F", "t")), ("TX", F.concat_ws("_", F.lit("title"), "t"), a("tex._transp._code_title_", "t", "_subtitle_", "t", "u")),
        ("TX", F.concat(F.lit("title_"), "t", F.lit("_subtitle_"), "t", "u"), a("tex._transp._code_title_", "t", "_subtitle_", "t", "u", "_chapter_", "c")),
        ("TX", F.concat_ws("_", F.lit("chapter"), "c"), F.concat(F.lit("<a href=tex._transp._code_section_"), "c", F.lit("."), "s", F.lit(">x</a>"))),
        ("CO", F.lit("root"), a("/statutes/crs_title_42_article_", "c")),
        ("CO", F.concat_ws("_", F.lit("article"), "c"), F.concat(F.lit("<a href=/crs_42-"), "c", F.lit("-"), "s", F.lit(">x</a><a href=/crs_42-9"), "c", F.lit("-1>other</a>"))),
        ("FL", F.lit("root"), a("/fla._stat.%5Fchapter_", "c")),
        ("FL", F.concat_ws("_", F.lit("chapter"), "c"), F.concat(F.lit("<a href=/fla._stat._"), "c", F.lit("."), "s", F.lit(">x</a>"))),
        ("NV", F.lit("root"), a("/nrs_chapter_", "c", "u")), ("NV", F.concat(F.lit("chapter_"), "c", "u"), a("/nrs_chapter_", "c", "u", "_sub-chapter_part_of_", "c")),
        ("NV", F.concat(F.lit("chapter_"), "c", "u", F.lit("_sub-chapter_part_of_"), "c"), F.concat(F.lit("<a href=/nrs_"), "c", "u", F.lit("."), "s", F.lit(">x</a><a href=/nrs_9"), "c", F.lit(".1>other</a>"))),
        ("OR", F.lit("root"), a("/ors_chapter_", "c")), ("OR", F.concat_ws("_", F.lit("chapter"), "c"), F.concat(F.lit("<a href=/ors_"), "c", F.lit("."), "s", F.lit(">x</a>"))),
    ]
    listed = F.explode(F.array(*(F.struct(F.lit(source).alias("source"), key.alias("key"), item.alias("item")) for source, key, item in edges)))
    items = s.select(listed.alias("e")).select("e.*").distinct()
    word = F.when(F.col("key") == "root", " Titles ").when(F.startswith("key", F.lit("title")), " Articles ").otherwise(" Sections ")
    return items.groupBy("source", "key").agg(F.array_join(F.array_sort(F.collect_list("item")), "").alias("items")).select(
        "source", "key", F.concat(F.lit("<body><a href='/'>home</a>"), word, "items", F.lit(" Stay Connected <a href='/about'>about</a></body>")).alias("html")
    )


@query("contents_walk", _CONTENTS)
def contents_walk(spark, folder):
    """All levels of the contents of seven sources at once, from their first pages."""
    pages = settle(_contents_pages(spark, folder), "contents")
    by = {s.jurisdiction: s for s in contents.SOURCES.values()}
    levels = ("root", "division", "text", *contents.LEVELS)
    own = F.struct(F.coalesce(*(F.when(F.contains(F.concat(F.lit("_"), "key", F.lit("_")), F.lit(f"_{k}_")), k) for k in reversed(levels))).alias("kind"), F.lit("").alias("number"), F.col("key"))
    each = F.coalesce(*(F.when(F.col("source") == code, contents.contents_links("html", own, source)) for code, source in by.items()))
    links = settle(pages.select("source", F.col("key").alias("of"), F.explode(each).alias("x")), "links")
    start = pages.where("key = 'root'").select("source", "key", F.lit("root").alias("kind"), F.lit("").alias("number"))

    def expand(level):
        parent = F.struct("source", F.col("of").alias("key"), F.col("parent_number").alias("number")).alias("parent")
        here = level.select("source", F.col("key").alias("of"), F.col("number").alias("parent_number"))
        return here.join(links, ["source", "of"]).select("source", "x.key", parent, "x.kind", "x.number")

    # keys are in lower case, as addresses are: numbers may differ in case only
    found = walk(start, expand, ["source", "key", "number"], shared_path(spark, "walk"))
    return found.select("source", "kind", "number", "depth", F.col("parent.number").alias("parent"))


#: An extraction with every kind of fault, by p_partkey % 8; the SQL lists the faults of each.
@query("extraction_faults", """
WITH f AS (
  SELECT p_partkey, unnest(CASE p_partkey % 8
    WHEN 1 THEN [{'path': 'source_quote', 'reason': 'missing'}]
    WHEN 2 THEN [{'path': 'amount', 'reason': 'not a number'}, {'path': 'items[' || (p_size % 4) || '].name', 'reason': 'missing'}]
    WHEN 3 THEN list_transform(range(p_size % 4 + 1), lambda j: {'path': 'items[' || j || '].size', 'reason': 'more than 40'})
    WHEN 4 THEN [{'path': '', 'reason': 'not JSON'}]
    WHEN 5 THEN [{'path': 'kind', 'reason': 'not one of part, tool'}, {'path': 'place.x' || p_size, 'reason': 'unknown field'}]
    WHEN 6 THEN [{'path': 'items', 'reason': 'not a list'}]
    WHEN 7 THEN [{'path': 'source_quote', 'reason': 'not in the source'}]
    ELSE [] END) AS f FROM part
)
SELECT p_partkey, f.path AS path, f.reason AS reason FROM f
""")  # fmt: skip
def extraction_faults(spark, folder):
    k, n = _i() % 8, _n() % 4
    named = F.transform(F.sequence(F.lit(0), n), lambda j: F.concat(F.lit('{"name": "'), "p_name", F.lit('", "size": '), F.when(k == 3, 40 + _n()).otherwise(_n() % 40), F.lit("}")))
    nameless = F.when(k == 2, F.lit(', {"size": 1}')).otherwise("")
    # the list of a fault in its last place has that place emptied
    items = F.when(k == 2, F.concat(F.array_join(F.slice(named, 1, n), ", "), F.when(n > 0, nameless).otherwise('{"size": 1}'))).otherwise(F.array_join(named, ", "))
    quoted = F.when(k == 1, "null").when(k == 7, '"nowhere to be found"').otherwise(F.concat(F.lit('"'), "p_name", F.lit('"')))
    js = F.concat(
        F.lit('{"source_quote": '), quoted, F.lit(', "amount": '), F.when(k == 2, F.lit('"much"')).otherwise(_i().cast("string")), F.lit(', "kind": "'), F.when(k == 5, "gift").otherwise("part"),
        F.lit('", "place": {"city": "x"'), F.when(k == 5, F.concat(F.lit(', "x'), _n(), F.lit('": 1'))).otherwise(""), F.lit('}, "items": '), F.when(k == 6, "3").otherwise(F.concat(F.lit("["), items, F.lit("]"))), F.when(k == 4, "").otherwise("}"),
    )
    item = Shape("object", fields={"name": Shape("text", required=True), "size": Shape("integer", most=40)})
    fields = {"source_quote": Shape("text", required=True), "amount": Shape("number"), "kind": Shape("text", one_of=("part", "tool")), "place": Shape("object", open=False, fields={"city": Shape("text")}), "items": Shape("list", items=item)}
    rows = spread(table(spark, folder, "part")).select(_i(), F.concat(F.lit("About "), "p_name").alias("text"), js.alias("js"))
    found = checked(rows, "js", Shape("object", fields=fields), "text")
    return found.select("p_partkey", F.explode("violations").alias("f")).select("p_partkey", "f.path", "f.reason")


@query("page_tables", """
WITH r AS (
  SELECT l_orderkey // 40 AS page, row_number() OVER (PARTITION BY l_orderkey // 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS n, * FROM lineitem
)
SELECT page, (n // 25)::INT AS "table", (n % 25)::INT AS row, array_to_string([l_orderkey::VARCHAR, CASE WHEN n % 25 % 7 = 3 THEN '' ELSE 'part ' || l_partkey END, l_returnflag, strftime(l_shipdate, '%Y-%m-%d')], '|') AS cells FROM r
""")  # fmt: skip
def page_tables_of_lines(spark, folder):
    """Lines printed as tables of four columns, 25 rows each, a cell empty here and there, every word's box moved a little; the
    cells come back."""
    page = F.floor(F.col("l_orderkey") / 40).alias("page")
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, folder, "lineitem").select(page, F.struct(*order, "l_returnflag", "l_shipdate").alias("l")).repartition("page")
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list("l")).alias("lines"))

    def placed(line, n):
        top = n * 14 + F.floor(n / 25) * 50
        sparse = F.when(n % 25 % 7 == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("part"), line["l_partkey"].cast("string")))
        cells = ((0, F.array(line["l_orderkey"].cast("string"))), (120, sparse), (300, F.array(line["l_returnflag"])), (340, F.array(F.date_format(line["l_shipdate"], "yyyy-MM-dd"))))

        def box(b):
            jitter = lambda k: (F.pmod(F.xxhash64("page", n, b["word"], F.lit(k)), F.lit(17)) - 8) / 8.0
            return F.struct(
                b["word"].alias("word"), (b["x0"] + jitter(1)).alias("x0"), (b["x0"] + 6 * F.length(b["word"]) - 2 + jitter(2)).alias("x1"), (top + jitter(3)).alias("top"), (top + 9 + jitter(3)).alias("bottom")
            )

        return F.transform(F.concat(*[_boxes(words, x) for x, words in cells]), box)

    words = pages.select("page", F.flatten(F.transform("lines", placed)).alias("words"))
    found = tables_in_pages(words, ["page"], column_gap=10.0)  # words of a cell are up to seven apart
    return found.select("page", "table", "row", F.array_join("cells", "|").alias("cells"))


def _boxes(words, x):
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), (F.lit(float(x)) + i * 27).alias("x0")))
