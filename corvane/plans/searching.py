"""Search queries: filtered pages, lookups, vector and hybrid ranking. `lang` stands for the jurisdiction, `source` for
the code, and a document's tags are its language and its source."""

from pyspark.sql import functions as F

from corvane.functions.text import base_section, clipped, keyword_score, query_stems
from corvane.functions.vectors import dot, literal
from corvane.operators import text_index
from corvane.operators.ranking import KEYWORD_WEIGHT, pool_size, top_k
from corvane.operators.search import any_of, clamp, overlap, page_with_total, token_filter, where_all
from corvane.operators.vector_index import build_index, probes_for, recall_curve, search
from corvane.plans.catalog import query, table
from corvane.session import shared_path


def _tags():
    return F.array(F.col("lang"), F.col("source"))


@query("statute_search", """
WITH f AS (SELECT * FROM documents WHERE text ILIKE '%the%' AND text ILIKE '%and%' AND upper(lang) IN ('EN', 'DE') AND list_has_any([lang, source], ['src1', 'src2', 'de']))
SELECT doc_id AS id, lang AS jurisdiction, source AS code, 'en' || ' § ' || doc_id AS title,
       CASE WHEN length(trim(text)) > 240 THEN left(trim(text), 240) || '…' ELSE trim(text) END AS summary, (SELECT count(*) FROM f) AS total
FROM f ORDER BY lang, doc_id LIMIT 50
""")  # fmt: skip
def statute_search(spark, folder):
    docs = table(spark, folder, "documents")
    found = where_all(docs, token_filter("the and", F.col("text")), any_of(F.upper("lang"), "en, de"), overlap(_tags(), "src1,src2,de"))
    page = page_with_total(found, ["lang", "doc_id"], clamp(None, 1, 50, 50))
    return page.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("jurisdiction"), F.col("source").alias("code"), F.concat(F.lit("en § "), F.col("doc_id")).alias("title"),
        clipped(F.trim("text"), 240).alias("summary"), "total",
    )


@query("jurisdiction_counts", "SELECT lang AS jurisdiction, source AS code, count(*) AS n FROM documents GROUP BY ALL")
def jurisdiction_counts(spark, folder):
    return table(spark, folder, "documents").groupBy(F.col("lang").alias("jurisdiction"), F.col("source").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("corpus_stats", """
SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM embeddings) AS n_chunks, (SELECT count(*) FROM labels) AS n_extractions
""")  # fmt: skip
def corpus_stats(spark, folder):
    counts = [table(spark, folder, t).agg(F.count(F.lit(1)).alias(n)) for t, n in (("documents", "n_documents"), ("embeddings", "n_chunks"), ("labels", "n_extractions"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


@query("point_lookup", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42")
def point_lookup(spark, folder):
    return table(spark, folder, "documents").where("doc_id = 42").select("doc_id", "lang", "source", "n_chars")


@query("missing_lookup", "SELECT doc_id, lang FROM documents WHERE false")
def missing_lookup(spark, folder):
    return where_all(table(spark, folder, "documents"), token_filter(" ", F.col("text")), any_of(F.col("lang"), ","), empty_if_none=True).select("doc_id", "lang")


@query("untagged_rows", "SELECT d.doc_id, d.source FROM documents d ANTI JOIN labels l USING (doc_id) WHERE n_chars >= 500")
def untagged_rows(spark, folder):
    docs = table(spark, folder, "documents").where("n_chars >= 500")
    return docs.join(table(spark, folder, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("empty_tags", "SELECT doc_id, CASE WHEN n_chars < 300 THEN 0 ELSE 1 END AS n_tags FROM documents WHERE n_chars < 300")
def empty_tags(spark, folder):
    tags = F.when(F.col("n_chars") < 300, F.array().cast("array<string>")).otherwise(F.array("lang"))
    return table(spark, folder, "documents").withColumn("tags", tags).where(F.size("tags") == 0).select("doc_id", F.size("tags").alias("n_tags"))


@query("code_name_filter", "SELECT doc_id, source FROM documents WHERE source ILIKE '%RC1%' AND upper(lang) = 'EN'")
def code_name_filter(spark, folder):
    return table(spark, folder, "documents").where(F.col("source").ilike("%RC1%") & (F.upper("lang") == "EN")).select("doc_id", "source")


@query("clamped_limit_page", "SELECT doc_id, lang FROM documents ORDER BY lang, doc_id LIMIT 200")
def clamped_limit_page(spark, folder):
    return table(spark, folder, "documents").orderBy("lang", "doc_id").limit(clamp(5000, 1, 200, 50)).select("doc_id", "lang")


@query("section_short_circuit", """
SELECT 'chunk-' || doc_id AS id, doc_id, left(text, 500) AS text, 1.0::DOUBLE AS score FROM documents WHERE doc_id::VARCHAR = '107'
""")  # fmt: skip
def section_short_circuit(spark, folder):
    wanted = base_section(F.lit("107(a)"))
    hit = table(spark, folder, "documents").where(base_section(F.col("doc_id").cast("string")) == wanted)
    return hit.select(F.concat(F.lit("chunk-"), F.col("doc_id")).alias("id"), "doc_id", F.left("text", F.lit(500)).alias("text"), F.lit(1.0).alias("score"))


def _query_vector(spark, folder):
    """The first stored vector, as the query."""
    row = table(spark, folder, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row.embedding) if row else [0.0]


_DOT = "list_dot_product(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query("vector_topk", f"SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings e ORDER BY {_DOT} DESC, vec_id LIMIT 20")
def vector_topk(spark, folder):
    score = dot(F.col("embedding"), literal(_query_vector(spark, folder)))
    return top_k(table(spark, folder, "embeddings"), score, "vec_id", 20).select("vec_id", F.round("score", 6).alias("score"))


@query("vector_topk_filtered", f"""
SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings e WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'de') ORDER BY {_DOT} DESC, vec_id LIMIT 10
""")  # fmt: skip
def vector_topk_filtered(spark, folder):
    docs = table(spark, folder, "documents").where("lang = 'de'").select(F.col("doc_id").alias("vec_id"))
    vectors = table(spark, folder, "embeddings").join(docs, "vec_id", "left_semi")
    score = dot(F.col("embedding"), literal(_query_vector(spark, folder)))
    return top_k(vectors, score, "vec_id", 10).select("vec_id", F.round("score", 6).alias("score"))


@query("keyword_scores", """
SELECT doc_id, round((contains(lower(text), 'thing')::INT + contains(lower(text), 'ention')::INT + contains(lower(text), 'reat')::INT) / 3.0::DOUBLE, 6) AS score FROM documents
""")  # fmt: skip
def keyword_scores(spark, folder):
    assert query_stems("the things entions reating of") == ["thing", "ention", "reat"]
    return table(spark, folder, "documents").select("doc_id", F.round(keyword_score("the things entions reating of", F.col("text")), 6).alias("score"))


@query("hybrid_search", f"""
WITH s AS (SELECT vec_id, {_DOT} AS semantic FROM embeddings e ORDER BY semantic DESC, vec_id LIMIT 300),
r AS (SELECT d.doc_id, d.lang, semantic + 0.6 * ((contains(lower(text), 'thing')::INT + contains(lower(text), 'ention')::INT) / 2.0::DOUBLE) AS score
      FROM s JOIN documents d ON d.doc_id = s.vec_id)
SELECT 'chunk-' || doc_id AS id, doc_id, round(score, 6) AS score FROM r WHERE lang IN ('en', 'fr') ORDER BY r.score DESC, doc_id LIMIT 10
""")  # fmt: skip
def hybrid_search(spark, folder):
    k = 10
    semantic = dot(F.col("embedding"), literal(_query_vector(spark, folder)))
    pool = top_k(table(spark, folder, "embeddings"), semantic, "vec_id", pool_size(k, filtered=True)).select(F.col("vec_id").alias("doc_id"), "score")
    docs = table(spark, folder, "documents").join(F.broadcast(pool), "doc_id")  # the pool's fixed size
    ranked = docs.withColumn("score", F.col("score") + KEYWORD_WEIGHT * keyword_score("things entions", F.col("text")))
    return ranked.where(F.col("lang").isin("en", "fr")).orderBy(F.desc("score"), "doc_id").limit(k).select(F.concat(F.lit("chunk-"), F.col("doc_id")).alias("id"), "doc_id", F.round("score", 6).alias("score"))


@query("statute_documents", "SELECT page_id, url FROM pages WHERE NOT starts_with(url, 'http://') AND page_id % 7 NOT IN (0, 3) AND page_id % 5 <> 0")
def statute_documents(spark, folder):
    from corvane.operators.search import statute_document

    url = F.when(F.col("url").startswith("http://"), F.regexp_replace("url", "^http://", "upload://")).otherwise(F.col("url"))
    kind = F.when(F.col("page_id") % 7 == 0, "verdict").when(F.col("page_id") % 7 == 3, "opinion")
    return table(spark, folder, "pages").where(statute_document(url, kind, F.col("page_id") % 5 == 0)).select("page_id", "url")


def _vector_index(spark, folder):
    """The stored vectors, indexed, and as queries every row whose id is divisible by 20."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    index = build_index(vectors, shared_path(spark, "vector-index"), "vec_id", "embedding")
    return index, vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


@query("vector_index_all_cells", """
SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS place
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 QUALIFY place <= 20
""")  # fmt: skip
def vector_index_all_cells(spark, folder):
    """The exact search through the index."""
    index, queries = _vector_index(spark, folder)
    return search(index, queries, "query_id", "embedding", 20).withColumn("score", F.round("score", 6))


@query("vector_index_topk")
def vector_index_topk(spark, folder):
    """The same through the fewest cells that find nine of ten rows. Tests measure the recall, as SQL can't know the cells."""
    index, queries = _vector_index(spark, folder)
    probes = probes_for(recall_curve(index, queries, "query_id", "embedding", 20), 0.9)
    return search(index, queries, "query_id", "embedding", 20, probes).withColumn("score", F.round("score", 6))


@query("skipping_search", "SELECT doc_id, lang FROM documents WHERE text ILIKE '%the%' AND text ILIKE '%ing%' AND text ILIKE '%tion%'")
def skipping_search(spark, folder):
    """A substring search over files laid out by language, through an index that leaves files out."""
    docs, index = shared_path(spark, "documents"), shared_path(spark, "trigrams")
    table(spark, folder, "documents").select("doc_id", "lang", "text").repartitionByRange(16, "lang", "doc_id").write.parquet(docs)
    text_index.index_files(spark, docs, ["text"], index)
    return text_index.skipping_search(spark, docs, ["text"], index, "The ING tion").select("doc_id", "lang")
