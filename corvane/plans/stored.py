"""Round trips through stored files, and small functions over whole tables."""

from pyspark.sql import functions as F

from corvane.functions import arrays, text, vectors
from corvane.functions.parsers import is_pdf
from corvane.operators.search import is_section_query
from corvane.plans.catalog import query, table
from corvane.session import shared_path
from corvane.sources import records, tables
from corvane.sources.pdf import whole_text


@query("lines_roundtrip", "SELECT DISTINCT source AS line FROM documents WHERE source IS NOT NULL AND trim(source) <> ''")
def lines_roundtrip(spark, folder):
    """Distinct values as sorted lines of a text file, read again."""
    out = shared_path(spark, "lines")
    tables.write_lines(table(spark, folder, "documents").where("source IS NOT NULL").select("source"), out)
    return records.read_lines(spark, out)


@query("manifest_appends", "SELECT event_type AS source_slug, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY event_type")
def manifest_appends(spark, folder):
    """A manifest of JSON lines that two runs add to."""
    out, events = shared_path(spark, "manifest"), table(spark, folder, "events")
    rows = events.select(F.col("event_type").alias("source_slug"), F.col("event_id").cast("string").alias("section"), (F.col("value") > 50).alias("valid"))
    for run in (0, 1):
        tables.append_manifest(rows.where(F.pmod(F.xxhash64("section"), F.lit(2)) == run), out)
    back = records.read_json_lines(spark, out, records.FETCH)
    n = F.col("section").cast("long")
    return back.groupBy("source_slug").agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("first"), F.max(n).alias("last"))


@query("swapped_table", "SELECT doc_id, upper(lang) AS lang FROM documents WHERE doc_id % 2 = 0")
def swapped_table(spark, folder):
    """A folder replaced by a table that reads it."""
    out = shared_path(spark, "swapped")
    table(spark, folder, "documents").select("doc_id", "lang").write.parquet(out)
    tables.swap_in(spark.read.parquet(out).where("doc_id % 2 = 0").withColumn("lang", F.upper("lang")), out)
    return spark.read.parquet(out)


@query("citation_index", "SELECT l_returnflag AS code, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def citation_index(spark, folder):
    """An index in files by code, of which the folders of edges are read."""
    out, lines = shared_path(spark, "index"), table(spark, folder, "lineitem")
    edges = lines.select(F.col("l_returnflag").alias("code"), F.concat(F.lit("CA/"), "l_partkey").alias("key"), "l_orderkey")
    cases = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey")
    tables.write_index(edges, cases, edges.agg(F.count(F.lit(1)).alias("edges")), out)
    back = spark.read.schema("key string, l_orderkey long, code string").json(f"{out}/by_statute")
    return back.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("csv_roundtrip", """SELECT p_partkey, p_name || ', "' || p_brand || '"' || chr(10) || p_type AS name FROM part""")
def csv_roundtrip(spark, folder):
    """Values with commas, quotes and line ends, written as CSV and read again."""
    out = shared_path(spark, "csv")
    rows = table(spark, folder, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_type").alias("name"))
    rows.write.option("header", True).option("escape", '"').csv(out)
    return records.read_csv(spark, out, "p_partkey long, name string")


@query("vector_bytes", "SELECT vec_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def vector_bytes(spark, folder):
    """Vectors as the bytes that stores keep, and back."""
    held = table(spark, folder, "embeddings").select("vec_id", vectors.to_bytes(F.col("embedding")).alias("blob"))
    back = held.select("vec_id", vectors.from_bytes(F.col("blob")).alias("v"))
    return back.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("whole_pages", """
SELECT conv_id::VARCHAR AS path, string_agg('[Page ' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL) WHERE trim(text) <> '' GROUP BY conv_id
""")  # fmt: skip
def whole_pages(spark, folder):
    """The pages of each file as one text, under their numbers."""
    pages = table(spark, folder, "conversations").groupBy(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("int").alias("page")).agg(F.min("text").alias("text"))
    return whole_text(pages)


@query("nested_extras", "SELECT event_id, user_id::VARCHAR AS user, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind, (1 + (event_id % 2 = 0)::INT)::INT AS n FROM events")
def nested_extras(spark, folder):
    """Fields of a JSON column as a map, without the blank ones."""
    c = F.col("event_id")
    js = F.to_json(F.struct(F.col("user_id").cast("string").alias("user"), F.when(c % 2 == 0, F.col("event_type")).otherwise("").alias("kind")))
    held = arrays.without_blanks(arrays.json_map(js))
    rows = table(spark, folder, "events").select("event_id", held.alias("m"))
    return rows.select("event_id", F.try_element_at("m", F.lit("user")).alias("user"), F.try_element_at("m", F.lit("kind")).alias("kind"), F.size("m").alias("n"))


@query("text_forms", r"""
SELECT page_id, replace(replace(url, '-', '%5f'), '%5f', '_') AS plain, 'Code of ' || page_id AS banner, contains(regexp_replace(html, '\s+', ' ', 'g'), 'the site') AS held, starts_with(html, '%PDF-') AS pdf,
       CASE page_id % 3 WHEN 0 THEN 'driv' WHEN 1 THEN 'box' ELSE 'is' END AS stem, length(html) AS n_chars
FROM pages
""")  # fmt: skip
def text_forms(spark, folder):
    """Escapes undone, banners cleaned, quotes found, endings cut and bytes decoded, on whole pages."""
    i = F.col("page_id")
    word = F.when(i % 3 == 0, "driving").when(i % 3 == 1, "boxes").otherwise("is")
    html = text.decoded(F.encode("html", "UTF-8"))
    return table(spark, folder, "pages").select(
        "page_id", text.underscored(F.replace("url", F.lit("-"), F.lit("%5f"))).alias("plain"), text.code_banner(F.concat(F.lit("Code of "), i, F.lit(" - ABC"))).alias("banner"), text.quote_in(F.lit(" the  site"), F.col("html")).alias("held"),
        is_pdf(F.encode("html", "UTF-8")).alias("pdf"), text.stem_column(word).alias("stem"), F.length(html).alias("n_chars"),
    )


@query("created_tables", "SELECT count(*) AS n FROM documents")
def created_tables(spark, folder):
    """Tables that are made if they aren't there, twice, and filled through their definition."""
    database = "stored_" + shared_path(spark, "db").rsplit("-", 1)[1]
    for _ in (1, 2):
        tables.create_tables(spark, database)
    try:
        spark.sql(f"DESCRIBE TABLE {database}.statutes").count()
        rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("source_url"), F.lit("").alias("fetched_at"), F.col("text").alias("raw_text"), F.lit("{}").alias("metadata"))
        rows.write.insertInto(f"{database}.documents")
        n = spark.table(f"{database}.documents").count()
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")
    return spark.createDataFrame([(n,)], "n long")


@query("section_queries", "SELECT p_partkey, p_partkey % 3 < 2 AS is_section FROM part")
def section_queries(spark, folder):
    """Which queries are a section's number."""
    asked = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_size", F.lit("."), "p_partkey")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), "p_partkey", F.lit("(a)"))).otherwise(F.concat("p_name", F.lit(" "), "p_partkey"))
    return table(spark, folder, "part").select("p_partkey", F.udf(is_section_query, "boolean", useArrow=True)(asked).alias("is_section"))
