"""Row builders, cards, reports and lookups."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import contents, parsers
from corvane.functions import text as texts
from corvane.operators import joins, lookups, reports, shapes
from corvane.operators.search import metadata_any_of
from corvane.plans.catalog import query, spread, table
from corvane.session import settle
from corvane.sources.page_tree import code_pages, law_sections, page_nodes


def _part(spark, folder):
    return table(spark, folder, "part")


_JUR = "CASE p_partkey % 8 WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' WHEN 2 THEN 'CO' WHEN 3 THEN 'FL' WHEN 4 THEN 'NV' WHEN 5 THEN 'OR' WHEN 6 THEN '' ELSE 'ZZ' END"
_LAW = "CASE p_partkey % 8 WHEN 0 THEN ' VEH' WHEN 1 THEN 'TN' WHEN 2 THEN 'CRS42' WHEN 3 THEN 'TXX' WHEN 4 THEN 'NRS43' WHEN 5 THEN 'ORS59' ELSE NULL END"
_META = "m(j, l, state, code, prefix, publisher) AS (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in shapes.CODE_NAMES) + ")"


@query("statutes_from_json", f"""
WITH {_META}, p AS (SELECT *, coalesce(nullif({_JUR}, ''), 'CA') AS j, coalesce(trim({_LAW}), 'VEH') AS l, p_size % 5 AS k FROM part WHERE p_partkey % 11 <> 0)
SELECT j AS jurisdiction_code, coalesce(state, j) AS jurisdiction_name, coalesce(CASE WHEN k = 1 THEN p_type END, code, l) AS code_name, l AS law_code, p_partkey::VARCHAR AS section_number,
       coalesce(prefix, j || ' ' || l || ' §') || ' ' || p_partkey AS canonical_citation,
       CASE k WHEN 0 THEN p_name WHEN 1 THEN '42' WHEN 2 THEN 'Ch ' || p_size || ' — Art' WHEN 3 THEN 'Art' END AS title,
       CASE WHEN k <> 4 THEN left(trim(p_name || ' ' || repeat(p_brand || ' ', 60)), 500) END AS statute_language, CASE WHEN k <> 4 THEN trim(p_name || ' ' || repeat(p_brand || ' ', 60)) ELSE '' END AS complete_statute,
       CASE WHEN k = 0 THEN '' ELSE 'https://x/' || p_partkey END AS source_url, coalesce(publisher, coalesce(state, j) || ' statutes') AS source_name
FROM p LEFT JOIN m USING (j, l)
""")  # fmt: skip
def statutes_from_json(spark, folder):
    i, k = F.col("p_partkey"), F.col("p_size") % 5
    fields = {
        "section_num": F.when(i % 11 == 0, " ").otherwise(F.concat(F.lit(" "), i, F.lit("\n"))), "jurisdiction": F.expr(_JUR), "law_code": F.expr(_LAW), "code_name": F.when(k == 1, F.col("p_type")), "section_name": F.when(k == 0, F.concat("p_name", F.lit("  "))),
        "title": F.when(k == 1, "42"), "chapter_title": F.when(k == 2, F.concat(F.lit("Ch  "), "p_size")), "article_title": F.when(k.isin(2, 3), "Art"),
        "text": F.when(k != 4, F.concat("p_name", F.lit("\n\n"), F.repeat(F.concat("p_brand", F.lit("  ")), 60))), "source_url": F.when(k != 0, F.concat(F.lit("https://x/"), i)),
    }
    payload = F.to_json(F.struct(*(c.cast("string").alias(n) for n, c in fields.items())))
    parsed = _part(spark, folder).select(F.from_json(payload, ", ".join(f"{n} string" for n in fields)).alias("r")).select("r.*")
    return shapes.parsed_to_statutes(parsed)


@query("statutes_from_seed", """
SELECT CASE WHEN p_size % 3 = 0 THEN 'NY' ELSE 'CA' END AS jurisdiction_code, CASE WHEN p_size % 3 = 0 THEN 'New York' ELSE 'California' END AS jurisdiction_name, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'Vehicle Code' END AS code_name,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'VEH' END AS law_code, p_partkey::VARCHAR AS section_number, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'Cal. Veh. Code § ' || p_partkey END AS canonical_citation,
       CASE WHEN p_size % 2 = 0 THEN p_type END AS title, p_name AS statute_language, '' AS complete_statute, NULL::VARCHAR AS plain_english_summary,
       CASE WHEN p_size % 4 = 0 THEN 'https://y/' || p_partkey ELSE 'https://x?lawCode=VEH&sectionNum=' || p_partkey END AS source_url
FROM part
""")  # fmt: skip
def statutes_from_seed(spark, folder):
    i, n = F.col("p_partkey"), F.col("p_size")
    cells = {
        "Section #": F.concat(F.lit(" "), i), "Source URL": F.when(n % 4 == 0, F.concat(F.lit("https://y/"), i)), "Jurisdiction": F.when(n % 3 == 0, "NY "), "State": F.when(n % 3 == 0, "New York"), "Code": F.lit(" "), "Statute": F.when(n % 2 == 0, F.col("p_type")),
        "Canonical Citation": F.lit(""), "Topic / Working Title": F.lit(None).cast("string"), "Statute Language": F.col("p_name"), "Complete Statute": F.lit(None).cast("string"), "Injury Relevance Reason": F.lit(" "),
    }
    seeds = _part(spark, folder).select(*(c.alias(k) for k, c in cells.items()))
    return shapes.seed_to_statutes(seeds, parsers.section_url("https://x", F.lit("VEH"), F.trim("`Section #`")))


@query("document_cards", """
WITH d AS (SELECT *, doc_id % 3 = 0 AS up FROM documents)
SELECT CASE WHEN up THEN 'upload-' || doc_id WHEN lang = 'en' THEN 'ca-vc-' || doc_id || '-5-a' ELSE lower(left(lang, 2)) || '-vc-' || doc_id END AS id, CASE WHEN up THEN 'DOC' WHEN lang = 'en' THEN 'CA' ELSE upper(left(lang, 2)) END AS jurisdiction,
       CASE WHEN up THEN 'Uploaded' WHEN lang = 'en' THEN 'California' ELSE lang END AS label, CASE WHEN up THEN 'Uploaded Document' WHEN lang = 'en' THEN 'Vehicle Code' ELSE 'Code' END AS code,
       CASE WHEN up THEN source || '.txt' WHEN lang = 'en' THEN doc_id || '.5(A)' ELSE '' END AS section, CASE WHEN up THEN source || '.txt' WHEN lang = 'en' THEN 'DUI' ELSE '§ ' END AS title,
       left(split_part(ltrim(text, chr(32) || chr(9) || chr(10) || chr(13)), chr(10), 1), 240) AS summary, CASE WHEN lang = 'en' THEN 'DUI|Other' WHEN up THEN 'Uploaded Document' ELSE '' END AS factors,
       CASE WHEN up THEN 'User upload' WHEN lang = 'en' THEN 'California Legislative Information' ELSE 'Legislature' END AS publisher, CASE WHEN up THEN '2024-05-06' ELSE '' END AS last_verified
FROM d
""")  # fmt: skip
def document_cards(spark, folder):
    up, en = F.col("doc_id") % 3 == 0, F.col("lang") == "en"
    meta = F.create_map(
        F.lit("upload"), F.when(up, "yes"), F.lit("filename"), F.when(up, F.concat("source", F.lit(".txt"))), F.lit("state"), F.when(en, "California").otherwise(F.col("lang")), F.lit("section"), F.when(en, F.concat("doc_id", F.lit(".5(A)"))),
        F.lit("citation"), F.when(en, "Cal. Veh. Code"), F.lit("category_gold"), F.when(en, "DUI"), F.lit("statute_name"), F.lit(" "),
    )
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("raw_text"), F.lit("u").alias("source_url"), F.when(up, "2024-05-06T07:08:09").alias("fetched_at"), meta.alias("meta"), F.when(en, F.array(F.lit("DUI"), F.lit("Other"))).alias("predicted")
    )
    return shapes.document_card(docs).withColumn("factors", F.array_join("factors", "|"))


@query("statute_cards", """
SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Cal. ' || p_partkey END AS title, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN p_brand ELSE '' END AS summary, CASE WHEN p_size % 2 = 0 THEN 'Unknown' ELSE p_brand END AS publisher,
       CASE WHEN p_size % 4 = 0 THEN '1970-01-01' ELSE '2024-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') END AS last_verified, '2024-06-01T12:00:00+00:00' AS made_at
FROM part
""")  # fmt: skip
def statute_cards(spark, folder):
    n = F.col("p_size")
    rows = _part(spark, folder).select(
        F.col("p_partkey").alias("id"), F.when(n % 2 == 0, F.col("p_name")).otherwise("").alias("title"), F.concat(F.lit("Cal. "), "p_partkey").alias("canonical_citation"), F.when(n % 3 == 0, F.col("p_type")).alias("plain_english_summary"),
        F.when(n % 3 == 1, F.col("p_brand")).alias("statute_language"), F.when(n % 2 == 1, F.col("p_brand")).alias("source_name"), F.when(n % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n % 28).cast("int"))).alias("updated_at"),
    )
    return shapes.statute_card(rows, F.lit("2024-06-01 12:00:00").cast("timestamp"))


@query("opinion_documents", r"""
SELECT doc_id AS cluster_id, CASE doc_id % 3 WHEN 0 THEN 'https://www.courtlistener.com/o/' || doc_id WHEN 1 THEN 'https://z/' || doc_id ELSE 'https://www.courtlistener.com/opinion/' || doc_id || '/' END AS source_url,
       CASE WHEN length(text) > 200 THEN CASE WHEN contains(left(text, 200), '<') THEN trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) ELSE text END
            WHEN length('<p>' || text || '</p>' || repeat('y', 150)) > 200 THEN trim(regexp_replace(regexp_replace('<p>' || text || '</p>' || repeat('y', 150), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) ELSE '' END AS text, source AS case_name, '' AS court
FROM documents
""")  # fmt: skip
def opinion_documents(spark, folder):
    d = F.col("doc_id") % 3
    hits = table(spark, folder, "documents").select(
        F.col("doc_id").alias("cluster_id"), F.when(d == 0, F.concat(F.lit("/o/"), "doc_id")).when(d == 1, F.concat(F.lit("https://z/"), "doc_id")).otherwise("").alias("absolute_url"), F.col("text").alias("plain_text"), F.lit(None).cast("string").alias("html_with_citations"),
        F.concat(F.lit("<p>"), "text", F.lit("</p>"), F.repeat(F.lit("y"), 150)).alias("html"), F.lit("").alias("html_lawbox"), F.lit("").alias("html_columbia"), F.concat(F.lit(" "), "source").alias("case_name"), F.lit(None).cast("string").alias("court"),
    )
    return shapes.opinion_document(hits)


@query("usable_amounts", "SELECT o_orderkey FROM orders WHERE o_custkey % 3 <> 0 OR o_totalprice > 100000")
def usable_amounts(spark, folder):
    third = F.col("o_custkey") % 3
    rows = table(spark, folder, "orders").select("o_orderkey", F.when(third == 1, 5.0).alias("a"), F.when(third == 2, -1.0).otherwise(0.0).alias("b"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("c"))
    return rows.where(shapes.any_amount("a", "b", "c")).select("o_orderkey")


@query("hits_by_url", """
WITH u AS (SELECT conv_id, 'https://x/' || (conv_id * 3 + turn // 2) AS url, turn FROM conversations), h AS (SELECT u.conv_id, p_partkey, min(turn) AS first FROM u JOIN part ON 'https://x/' || p_partkey = url GROUP BY ALL)
SELECT conv_id, p_partkey FROM h QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY first, p_partkey) <= 4
""")  # fmt: skip
def hits_by_url(spark, folder):
    """A reply's search hits as the statutes with their URLs, each once, four at most: the feature is a short list."""
    hits = table(spark, folder, "conversations").select("conv_id", "turn", F.concat(F.lit("https://x/"), F.expr("conv_id * 3 + turn div 2")).alias("url"))
    statutes = _part(spark, folder).select("p_partkey", F.concat(F.lit("https://x/"), "p_partkey").alias("url"))
    return lookups.hits_by(hits, statutes, ["url"], ["conv_id"], "turn", "p_partkey", 4).select("conv_id", "p_partkey")


@query("index_with_statutes", """
SELECT DISTINCT l_orderkey, 'CA/VEH/' || l_partkey AS key, p_name AS title FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 2 = 0
""")  # fmt: skip
def index_with_statutes(spark, folder):
    """Index edges joined with the statutes that they cite, on jurisdiction, code and section; distinct edges first."""
    edges = table(spark, folder, "lineitem").select("l_orderkey", F.concat(F.lit("CA/VEH/"), "l_partkey").alias("key"))
    statutes = _part(spark, folder).where("p_size % 2 = 0").withColumn("title", F.col("p_name"))
    return lookups.cited_rows(edges, statutes, "key", [F.lit("CA"), F.lit("VEH"), F.col("p_partkey").cast("string")], ["title"]).select("l_orderkey", "key", "title")


@query("first_chunk_of_match", """
WITH f AS (SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) = 1)
SELECT doc_id, f.turn AS chunk_idx, f.text AS text FROM documents JOIN f ON f.conv_id = doc_id WHERE source IN ('src1', 'src2', 'src3')
""")  # fmt: skip
def first_chunk_of_match(spark, folder):
    """Documents that match, each with its first chunk; those without chunks go."""
    chunks = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_idx"), "text")
    docs = table(spark, folder, "documents").where(F.col("source").isin("src1", "src2", "src3")).select("doc_id")
    return lookups.first_child(docs, chunks, "doc_id", "chunk_idx", ["text"])


@query("base_hits_first", """
WITH e AS (SELECT l_orderkey AS iid, 'CA/VEH/' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN '/a' ELSE '' END AS key FROM lineitem), q AS (SELECT 'CA/VEH/' || p_partkey || '/a' AS asked, 'CA/VEH/' || p_partkey AS base FROM part WHERE p_size = 7)
SELECT asked, iid, min(CASE WHEN key = base THEN 0 ELSE 1 END)::INT AS place FROM q JOIN e ON key = asked OR key = base GROUP BY asked, iid
""")  # fmt: skip
def base_hits_first(spark, folder):
    """What is asked by a four-part key: hits of the base key come first, then those of the key; each instruction once."""
    edges = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("iid"), F.concat(F.lit("CA/VEH/"), "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, "/a").otherwise("")).alias("key"))
    asked = _part(spark, folder).where("p_size = 7").select(F.concat(F.lit("CA/VEH/"), "p_partkey", F.lit("/a")).alias("asked"))
    return lookups.citing_items(asked, edges, "asked", "key", "iid")


@query("consolidation_totals", "SELECT count(DISTINCT source) AS files, count(*) FILTER (length(text) > 100) AS records, count(*) FILTER (length(text) <= 100) AS skipped FROM documents")
def consolidation_totals(spark, folder):
    return reports.consolidation_totals(table(spark, folder, "documents"), F.col("source"), F.length("text") <= 100)


@query("tag_tallies", "SELECT count(*) AS total, count(*) FILTER (toxic = 1) AS specific, count(*) FILTER (toxic = 0) AS other, count(*) FILTER (quality = 0) AS errors FROM labels")
def tag_tallies(spark, folder):
    c = F.col
    return table(spark, folder, "labels").agg(F.count(F.lit(1)).alias("total"), F.count_if(c("toxic") == 1).alias("specific"), F.count_if(c("toxic") == 0).alias("other"), F.count_if(c("quality") == 0).alias("errors"))


@query("tag_error_samples", "SELECT doc_id, 'doc ' || doc_id AS message FROM labels WHERE quality = 0 ORDER BY doc_id LIMIT 5")
def tag_error_samples(spark, folder):
    return shapes.error_samples(table(spark, folder, "labels"), F.col("quality") == 0, F.concat(F.lit("doc "), "doc_id"), "doc_id")


@query("first_failures", "SELECT page_id, 'short page' AS message FROM pages WHERE length(html) % 7 = 0 ORDER BY page_id LIMIT 10")
def first_failures(spark, folder):
    return shapes.error_samples(table(spark, folder, "pages"), F.length("html") % 7 == 0, F.lit("short page"), "page_id", 10)


@query("toc_counts", r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s+href="(/[^"]*)"', 1)) AS href FROM pages) SELECT count(DISTINCT page_id) AS pages, count(DISTINCT href) AS sections, count(*) AS edges FROM l
""")  # fmt: skip
def toc_counts(spark, folder):
    links = table(spark, folder, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s+href="(/[^"]*)"'), F.lit(1))).alias("href"))
    return reports.graph_counts(links, {"pages": "page_id", "sections": "href"})


@query("instruction_counts", """
SELECT l_orderkey, count(*) AS n_sources, count(*) FILTER (l_returnflag <> 'N') AS n_statutes, count(*) FILTER (l_returnflag = 'N') AS n_cases FROM lineitem GROUP BY l_orderkey
""")  # fmt: skip
def instruction_counts(spark, folder):
    case = F.col("l_returnflag") == "N"
    return reports.counts_by(table(spark, folder, "lineitem"), ["l_orderkey"], {"n_statutes": ~case, "n_cases": case}, "n_sources")


@query("citations_by_role", """
WITH e AS (SELECT l_orderkey AS iid, 'CA/VEH/' || l_partkey AS key, min(struct_pack(r := CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, p := l_linenumber)) AS b FROM lineitem GROUP BY ALL)
SELECT iid, string_agg(key || ':' || ['title', 'sources', 'directions'][b.r + 1], ',' ORDER BY b.r, b.p, key) AS cited FROM e GROUP BY iid
""")  # fmt: skip
def citations_by_role(spark, folder):
    """Each instruction's citations, each once in its best role, by role and place. An instruction's list is its own."""
    role = F.when(F.col("l_returnflag") == "A", "title").when(F.col("l_returnflag") == "R", "sources").otherwise("directions")
    edges = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("iid"), F.concat(F.lit("CA/VEH/"), "l_partkey").alias("key"), role.alias("role"), "l_linenumber")
    found = lookups.citations_by_role(edges, "iid", "key", F.col("role"), "l_linenumber", ["title", "sources", "directions"])
    return found.select("iid", F.array_join(F.transform("cited", lambda x: F.concat(x["key"], F.lit(":"), x["role"])), ",").alias("cited"))


@query("coverage_ratios", """
WITH h AS (SELECT p_size AS section, CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS hit FROM part) SELECT count(*) AS n_rows, sum(hit)::BIGINT AS hits, count(DISTINCT section) AS sections, count(DISTINCT CASE WHEN hit = 1 THEN section END) AS sections_hit FROM h
""")  # fmt: skip
def coverage_ratios(spark, folder):
    return reports.coverage(_part(spark, folder), F.col("p_retailprice") > 1000, F.col("p_size"))


@query("richer_hits", """
WITH h AS (SELECT conv_id * 100 + turn AS place, conv_id // 3 AS id, text, role = 'assistant' AS whole FROM conversations)
SELECT id, min(place) AS place, arg_min(text, struct_pack(s := CASE WHEN whole THEN 0 ELSE 1 END, a := place)) AS text, bool_or(whole) AS whole FROM h GROUP BY id
""")  # fmt: skip
def richer_hits(spark, folder):
    """A statute that comes again keeps its place; its full text takes the place of a snippet."""
    hits = table(spark, folder, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("place"), F.expr("conv_id div 3").alias("id"), "text", (F.col("role") == "assistant").alias("whole"))
    return shapes.richer_wins(hits, "id", "place", "whole")


@query("newest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def newest_first(spark, folder):
    """A page of the newest rows: a top-k, so only so many rows of each task meet."""
    return table(spark, folder, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)


@query("sections_to_fetch", "SELECT DISTINCT section FROM (SELECT p_size::VARCHAR AS section FROM part UNION ALL SELECT unnest(range(10, 21))::VARCHAR UNION ALL SELECT unnest(range(100, 106))::VARCHAR)")
def sections_to_fetch(spark, folder):
    spans = spark.createDataFrame([(10, 20), (100, 105)], "lo int, hi int")
    return shapes.section_list(known=_part(spark, folder).select(F.col("p_size").cast("string").alias("section")), spans=spans)


@query("vector_literals", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']' AS literal FROM embeddings")
def vector_literals(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", shapes.vector_literal(F.col("embedding")).alias("literal"))


@query("reply_links", "SELECT conv_id, turn, unnest(['https://x.org/' || conv_id, 'http://y.org/a?b=' || turn]) AS link FROM conversations")
def reply_links(spark, folder):
    said = F.concat("text", F.lit(" see (https://x.org/"), "conv_id", F.lit("), http://y.org/a?b="), "turn", F.lit(". Also https://x.org/"), "conv_id", F.lit("."))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.explode(parsers.links_in(said)).alias("link"))


@query("toc_of_more_sources", "SELECT p_partkey, p_size || '.' || p_partkey AS fl, p_size || 'a.' || p_partkey AS nv, p_size || '.' || p_partkey AS orr, (p_size + 100) || '-A,' || (p_partkey % 9000 + 1000) AS ny FROM part")
def toc_of_more_sources(spark, folder):
    n, i = F.col("p_size"), F.col("p_partkey")
    page = F.concat(
        F.lit('<a href="/fla._stat._'), n, F.lit("."), i, F.lit('">a</a><a href="/nrs_'), n, F.lit("a."), i, F.lit('">b</a><a href="/ors_'), n, F.lit("."), i, F.lit('">c</a><body>Sections '), n + 100, F.lit("-A Duty to stop "), i % 9000 + 1000, F.lit(" Speed limits in towns Stay Connected 99 Not this</body>"),
    )
    listed = {k: F.array_join(contents.toc_sections(page, contents.SOURCES[s]), ",") for k, s in (("fl", "fl_public_law"), ("nv", "nv_public_law"), ("orr", "or_public_law"))}
    return spread(_part(spark, folder)).select(i, *(v.alias(k) for k, v in listed.items()), F.array_join(parsers.listed_rows(page, "Sections", "Stay Connected"), ",").alias("ny"))


@query("law_bodies", """
WITH r AS (SELECT *, p_size % 3 AS k FROM part), x AS (
  SELECT p_partkey, k, unnest(CASE k WHEN 0 THEN [{'place': 0, 'label': 'a', 'text': p_name || ' see', 'level': 1.0}, {'place': 1, 'label': '2.1', 'text': p_brand, 'level': 2.0}] ELSE [{'place': 0, 'label': NULL, 'text': 'Whole ' || p_name, 'level': 0.0}] END) AS s FROM r
)
SELECT p_partkey, s.place::INT AS place, s.label AS label, s.text AS text, s.level::DOUBLE AS level, CASE k WHEN 0 THEN 'Acts ' || p_partkey ELSE 'Last modified: 2024' END AS history FROM x
""")  # fmt: skip
def law_bodies(spark, folder):
    i = F.col("p_partkey")
    parts = F.concat(
        F.lit('<section class="leaf level-1"><h2>(a)</h2> '), "p_name", F.lit(' see <a class="pedantic" href="#">again</a></section><section class="non-meta level-2"><h3>2.1.</h3><p>'), "p_brand", F.lit('</p></section><section class="level-2"><h3>(b)</h3> </section><section class="meta">Acts '), i, F.lit("</section></div>")
    )
    whole = F.concat(F.lit("Whole "), "p_name", F.lit(" Source: there</div>"))
    page = F.concat(F.lit('<div>head<div id="leaf-statute-body">'), F.when(F.col("p_size") % 3 == 0, parts).otherwise(whole))
    nodes = page_nodes(spread(_part(spark, folder)).select(i, page.alias("html")), "p_partkey", "html")
    found = law_sections(settle(nodes.where("tag IS NULL"), "nodes"), "p_partkey")
    return found.withColumn("history", parsers.note_or_modified(F.col("history"), F.lit("2024")))


@query("nested_law_bodies", """
WITH RECURSIVE t AS (
  SELECT p_partkey, p_name, p_size % 5 + 1 AS d, p_name || ' ' || d || ' tail ' || d AS text FROM part
  UNION ALL SELECT p_partkey, p_name, d - 1, p_name || ' ' || (d - 1) || ' ' || text || ' tail ' || (d - 1) FROM t WHERE d > 1
)
SELECT p_partkey, (d - 1)::INT AS place, CASE WHEN d % 2 = 0 THEN d::VARCHAR ELSE chr((96 + d)::INT) END AS label, text, d::DOUBLE AS level, 'Acts ' || p_partkey AS history FROM t
""")  # fmt: skip
def nested_law_bodies(spark, folder):
    """Sections inside sections, one to five deep, with text before and behind the inner one."""
    name, depth = F.col("p_name"), F.col("p_size") % 5 + 1

    def around(inner, d):
        head = F.when(d % 2 == 0, F.concat(d, F.lit("."))).otherwise(F.concat(F.lit("("), F.char(96 + d), F.lit(")")))
        return F.concat(F.lit('<section class="non-meta level-'), d, F.lit('"><h2>'), head, F.lit("</h2><p>"), name, F.lit(" <i>"), d, F.lit('</i><a class="pedantic">x</a></p>'), inner, F.lit(" tail "), d, F.lit("</section>"))

    nested = F.aggregate(F.sequence(depth, F.lit(1), F.lit(-1)), F.lit(""), around)
    page = F.concat(F.lit('<section>other</section><div id="leaf-statute-body">'), nested, F.lit('<section class="meta">Acts <b>'), "p_partkey", F.lit("</b></section></div><section>footer</section>"))
    nodes = page_nodes(spread(_part(spark, folder)).select("p_partkey", page.alias("html")), "p_partkey", "html")
    return law_sections(settle(nodes.where("tag IS NULL"), "nodes"), "p_partkey")


@query("section_pages", "SELECT p_partkey, p_size || '.' || p_partkey AS number, '(Amended ' || p_partkey || '.)' AS history FROM part")
def section_pages(spark, folder):
    page = F.concat(
        F.lit("<div id='codeLawSectionNoHead'><h6>RULES</h6><i>note</i><font><h6 style='x'><b>"), "p_size", F.lit("."), "p_partkey", F.lit(".</b></h6><p>(a) text</p><p><i>(Amended "), "p_partkey", F.lit(".)</i></p><i> </i></font></div>"),
    )
    nodes = page_nodes(spread(_part(spark, folder)).select("p_partkey", page.alias("html")), "p_partkey", "html")
    return code_pages(settle(nodes, "nodes"), "p_partkey").select("p_partkey", F.col("section").alias("number"), "history")


@query("code_page_parts", """
WITH r AS (SELECT *, p_size % 4 AS k, p_partkey % 3 AS c FROM part), x AS (
  SELECT *, unnest(range(k + 1)) AS j FROM r
)
SELECT p_partkey, 'Vehicle Code' AS code_name, CASE c WHEN 0 THEN 'chapter:2:Signs:' || p_size || ',division:11:Rules:' WHEN 1 THEN 'division:11:Rules:' ELSE '' END AS levels, p_size || '.5' AS section, j::INT AS place,
       CASE WHEN j > 0 THEN j::VARCHAR END AS label, p_name || ' ' || j AS text, j * 1.5::DOUBLE AS depth
FROM x
""")  # fmt: skip
def code_page_parts(spark, folder):
    """The hierarchy and the paragraphs of code pages: none to two levels above, one to four paragraphs, each with its margin."""
    row = F.lit("<p style='margin-left: "), F.lit("em;'>")
    paragraph = lambda j: F.concat(row[0], j * F.lit(1.5), row[1], F.when(j > 0, F.concat(F.lit("("), j, F.lit(") "))).otherwise(""), "p_name", F.lit(" <b>"), j, F.lit("</b>"))
    paragraphs = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), paragraph), "")
    c = F.col("p_partkey") % 3
    division = F.when(c < 2, "<h4>DIVISION 1. Old</h4><h4><b>DIVISION 11.</b> Rules</h4>").otherwise("<h4>General Provisions</h4>")
    chapter = F.when(c == 0, F.concat(F.lit("<h5>CHAPTER 2. Signs [ "), "p_size", F.lit(" ]</h5>"))).otherwise("")
    page = F.concat(F.lit("<p>menu</p><div id=codeLawSectionNoHead><h4>Vehicle Code - VEH</h4>"), division, chapter, F.lit("<i>note</i><font face='x'><h6>"), "p_size", F.lit(".5.</h6>"), paragraphs, F.lit("</font></div>"))
    nodes = page_nodes(spread(_part(spark, folder)).select("p_partkey", page.alias("html")), "p_partkey", "html")
    found = code_pages(settle(nodes, "nodes"), "p_partkey").withColumn("h", F.array_sort(F.map_entries("hierarchy")))
    level = lambda e: F.concat_ws(":", e["key"], e["value"]["ident"], e["value"]["title"], F.coalesce(e["value"]["range"], F.lit("")))
    return found.select("p_partkey", "code_name", F.array_join(F.transform("h", level), ",").alias("levels"), "section", F.posexplode("paragraphs").alias("place", "p")).select("p_partkey", "code_name", "levels", "section", "place", "p.*")


@query("url_lookup", "SELECT page_id, url FROM pages WHERE url = (SELECT min(url) FROM pages)")
def url_lookup(spark, folder):
    """The page with a URL, which itself is one row of a plan."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return pages.join(F.broadcast(pages.agg(F.min("url").alias("url"))), "url", "left_semi").select("page_id", "url")


@query("hits_with_documents", """
SELECT c.conv_id, c.turn, coalesce(d.source, '{}') AS source, coalesce(d.lang, '') AS lang FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 13 + c.turn
""")  # fmt: skip
def hits_with_documents(spark, folder):
    """Search hits with their documents; a hit whose document is gone stays, with nothing in it."""
    hits = table(spark, folder, "conversations").select("conv_id", "turn", (F.col("conv_id") * 13 + F.col("turn")).alias("doc_id"))
    return lookups.with_rows(hits, table(spark, folder, "documents"), ["doc_id"], {"source": F.lit("{}"), "lang": F.lit("")}).drop("doc_id")


@query("project_edits", """
WITH p AS (SELECT conv_id AS id, list(DISTINCT turn) AS items FROM conversations GROUP BY conv_id)
SELECT id, CASE WHEN id % 3 = 0 THEN 'renamed' ELSE 'project ' || id END AS name, array_to_string(list_sort(list_filter(list_distinct(list_append(list_append(items, 1), 99)), lambda x: x <> 0)), ',') AS items FROM p WHERE id % 5 <> 0
UNION ALL SELECT -1, 'new', ''
""")  # fmt: skip
def project_edits(spark, folder):
    """Projects after a create, adds of items (each once), a removal, renames and deletions."""
    c = F.col("id")
    projects = table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.concat(F.lit("project "), F.first("conv_id").cast("string")).alias("name"), F.collect_set("turn").alias("items"))
    edit = lambda at, kind, item=None, name=None: F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"), F.lit(name).cast("string").alias("name"), F.lit(item).cast("long").alias("item"))
    of_all = F.concat(
        F.array(edit(1, "add", 1), edit(2, "add", 99), edit(3, "add", 99), edit(4, "remove", 0), edit(5, "create", name="again")), F.when(c % 3 == 0, F.array(edit(6, "rename", name="renamed"))).otherwise(F.slice(F.array(edit(0, "")), 1, 0)),
        F.when(c % 5 == 0, F.array(edit(7, "delete"), edit(8, "add", 5))).otherwise(F.slice(F.array(edit(0, "")), 1, 0)),
    )
    edits = projects.select("id", F.inline(of_all)).unionByName(spark.createDataFrame([(-1, 1, "create", "new", None), (-2, 1, "add", None, 5)], "id long, at int, kind string, name string, item long"))
    done = lookups.edit_projects(projects, edits)
    return done.select("id", "name", F.array_join(F.array_sort("items"), ",").alias("items"))


# ---- operators over parameters, on the supplied tables


@query("section_markdown", """
SELECT p_partkey, '# Vehicle Code' || chr(10) || CASE p_partkey % 3 WHEN 0 THEN '## Division ' || p_size || '. ' || p_brand || ' [1 - 9]' || chr(10) || '### Chapter 2' || chr(10) WHEN 1 THEN '#### Article 3. Of signs' || chr(10) ELSE '' END
       || '##### § ' || p_partkey || chr(10) || chr(10) || p_name || chr(10) || chr(10) || '    (a) ' || p_type || chr(10) || chr(10) || '        (1) ' || p_brand || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || '*(Added ' || p_size || '.)*' ELSE '' END || chr(10) AS markdown,
       '# Law' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '### Chapter 2' || chr(10) WHEN p_partkey % 3 = 1 THEN '#### Article 3. Of signs' || chr(10) ELSE '' END || '##### § ' || p_partkey || ' — ' || p_name || chr(10) AS law
FROM part
""")  # fmt: skip
def section_markdown(spark, folder):
    level = lambda name, ident, title, reach: F.struct(F.lit(name).alias("key"), F.struct(ident.alias("ident"), title.alias("title"), reach.alias("range")).alias("value"))
    none, third = F.lit(None).cast("string"), F.col("p_partkey") % 3
    levels = F.when(third == 0, F.array(level("division", F.col("p_size").cast("string"), F.col("p_brand"), F.lit("1 - 9")), level("chapter", F.lit("2"), none, none))).when(third == 1, F.array(level("article", F.lit("3"), F.lit("Of signs"), none)))
    hierarchy = F.map_from_entries(F.coalesce(levels, F.slice(F.array(level("x", none, none, none)), 1, 0)))
    part = lambda label, text, depth: F.struct(label.alias("label"), F.col(text).alias("text"), F.lit(float(depth)).alias("depth"))
    parts = F.array(part(none, "p_name", 0), part(F.lit("a"), "p_type", 1.5), part(F.lit("1"), "p_brand", 2))
    history = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("(Added "), "p_size", F.lit(".)")))
    number = F.col("p_partkey").cast("string")
    return _part(spark, folder).select(
        "p_partkey", texts.section_markdown(F.lit("Vehicle Code"), hierarchy, number, parts, history).alias("markdown"),
        texts.section_markdown(F.lit("Law"), hierarchy, number, F.slice(parts, 1, 0), none, F.col("p_name"), texts.LAW_LEVELS, ranges=False).alias("law"),
    )


@query("statute_result_texts", """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE text ILIKE '%the%' QUALIFY n <= 10), b AS (
  SELECT lang, n, '[' || n || '] ' || CASE WHEN doc_id % 3 = 0 THEN 'Cit. ' || doc_id ELSE coalesce(lang, '') || ' ' || coalesce(source, '') || ' § ' || doc_id END || chr(10) || '    id: ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '    title: T' || doc_id ELSE '' END
    || chr(10) || '    factors: a, ' || source || chr(10) || '    excerpt: ' || replace(left(trim(text), 500), chr(10), ' ') || CASE WHEN length(trim(text)) > 500 THEN '…' ELSE '' END AS block FROM h
)
SELECT lang, count(*) AS n, 'Found ' || count(*) || ' statute(s) for query=''the'':' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY n) AS text FROM b GROUP BY lang
""")  # fmt: skip
def statute_result_texts(spark, folder):
    """For each language the first ten documents with a word, as one text for a tool."""
    docs = table(spark, folder, "documents").where(F.col("text").ilike("%the%"))
    best = docs.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("_n <= 10")
    hits = best.select(
        "lang", F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Cit. "), "doc_id")).alias("canonical_citation"), F.col("lang").alias("jurisdiction_code"), F.col("source").alias("code_name"),
        F.col("doc_id").cast("string").alias("section_number"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("T"), "doc_id")).alias("title"), F.array(F.lit("a"), "source").alias("factors"), F.lit("").alias("source_url"),
        F.col("text").alias("complete_statute"),
    )
    lead, lines = shapes.statute_lines()
    found = F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" statute(s) for query='the':"))
    return shapes.result_texts(hits, ["lang"], ["id"], found, lines, lead)


@query("comparables", """
WITH e AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_totalprice END AS total, CASE WHEN o_orderkey % 5 = 1 THEN o_totalprice / 2 END AS part FROM orders)
SELECT o_orderkey AS extraction_id, doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Cit. ' || o_orderkey WHEN doc_id % 2 = 0 THEN '(2020-03-0' || (doc_id % 9 + 1) || ')' ELSE coalesce(nullif(trim(o_clerk), ''), 'Unknown case') END AS citation, o_orderstatus AS jurisdiction,
       CASE WHEN doc_id % 2 = 0 THEN 2020 ELSE 1999 END::INT AS year, CASE WHEN o_orderpriority ILIKE '%low%' THEN 'settlement' ELSE 'verdict' END AS kind, round(coalesce(nullif(total, 0), coalesce(part, 0)), 4) AS award
FROM (SELECT *, 'x' AS o_clerk FROM e) JOIN documents d ON d.doc_id = o_orderkey % 700 WHERE coalesce(nullif(total, 0), coalesce(part, 0)) <> 0
""")  # fmt: skip
def comparables(spark, folder):
    """Verdicts found in documents, with an amount in one of three fields; those of documents that are gone are left out."""
    k, price, none = F.col("o_orderkey"), F.col("o_totalprice").cast("double"), F.lit(None).cast("double")
    found = table(spark, folder, "orders").select(
        k.alias("extraction_id"), (k % 700).alias("doc_id"), F.when(k % 5 == 0, 0.0).when(k % 5 == 1, none).otherwise(price).alias("total_amount_usd"), F.when(k % 5 == 1, price / 2).alias("compensatory_amount_usd"), none.alias("punitive_amount_usd"),
        F.when(F.col("o_orderpriority").ilike("%low%"), "Settled").alias("award_type"), F.when(k % 4 == 0, F.concat(F.lit("Cit. "), k)).otherwise(" ").alias("citation"), F.lit("x").alias("case_name"), F.col("o_orderstatus").alias("jurisdiction"),
        F.lit("1999-05-01").alias("decision_date"),
    )
    docs = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("2020-03-0"), F.col("doc_id") % 9 + 1)).otherwise("").alias("date_filed"))
    return shapes.comparables(found, docs).withColumn("award", F.round("award", 4))


@query("project_statutes", """
WITH p AS (SELECT conv_id AS project, unnest(list(turn * 7 + conv_id ORDER BY turn)) AS doc_id, generate_subscripts(list(turn * 7 + conv_id ORDER BY turn), 1) - 1 AS position FROM conversations GROUP BY conv_id)
SELECT project, position::INT AS position, doc_id, lang FROM p JOIN documents USING (doc_id)
""")  # fmt: skip
def project_statutes(spark, folder):
    """The documents that projects hold, in the projects' order."""
    items = F.transform(F.array_sort(F.collect_list("turn")), lambda t: t * 7)
    projects = table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("id")).agg(items.alias("turns")).select("id", F.transform("turns", lambda t: t + F.col("id")).alias("items"))
    return shapes.project_rows(projects, table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").select("project", "position", "doc_id", "lang")


@query("ingest_histogram", """
SELECT s AS category, count(doc_id) AS n FROM (SELECT unnest(['ok', 'miss', 'error', 'skip']) AS s) LEFT JOIN (
  SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' OR doc_id % 11 = 0 THEN 'skip' WHEN doc_id % 7 = 0 THEN 'error' WHEN n_chars % 3 = 0 THEN 'miss' ELSE 'ok' END AS status FROM documents
) ON s = status GROUP BY s
""")  # fmt: skip
def ingest_histogram(spark, folder):
    i = F.col("doc_id")
    status = reports.ingest_status(F.col("text"), F.when(i % 7 == 0, "refused"), F.col("n_chars") % 3, i % 11 == 0)
    return reports.status_histogram(table(spark, folder, "documents"), status)


@query("tag_summary", """
SELECT count(*) AS total, count(*) FILTER (doc_id % 6 <> 0 AND doc_id % 4 IN (1, 2)) AS specific, count(*) FILTER (doc_id % 6 <> 0 AND doc_id % 4 = 3) AS other, count(*) FILTER (doc_id % 6 = 0) AS errors FROM documents
""")  # fmt: skip
def tag_summary(spark, folder):
    i = F.col("doc_id") % 4
    tags = F.when(i == 1, F.array(F.lit("Speed"))).when(i == 2, F.array(F.lit("Other"), F.lit("Speed"))).when(i == 3, F.array(F.lit("Other"), F.lit("Other")))
    return reports.tag_tallies(table(spark, folder, "documents"), tags, F.when(F.col("doc_id") % 6 == 0, "failed"), "Other")


@query("metadata_filter", "SELECT doc_id, lang FROM documents WHERE upper(lang) IN ('DE', 'FR')")
def metadata_filter(spark, folder):
    """A filter on a field of a JSON column; rows whose metadata isn't JSON, or lacks the field, meet no value."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.to_json(F.struct(F.col("lang").alias("jurisdiction"))).alias("metadata"))
    return docs.where(metadata_any_of(F.col("metadata"), "jurisdiction", "de, fr,")).select("doc_id", "lang")
