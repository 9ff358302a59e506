"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.alignment import align
from corvane.llm.common import WHITE, read_table, shared_path
from corvane.llm.digest import against_next
from corvane.llm.exact_dedup import exact_dedup
from corvane.llm.html_text import extract_text
from corvane.llm.language_id import fit_languages, held_out, identify
from corvane.llm.line_dedup import drop_repeated_lines
from corvane.llm.mixing import Mix, mix_sources
from corvane.llm.ordinal import fit_ordinal, grade, rating
from corvane.llm.packing import pack
from corvane.llm.periodic import find_runs
from corvane.llm.quality_rules import fit_rules, quality_report
from corvane.llm.simhash import simhash_groups
from corvane.llm.warc import page_records, read_warc, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_page_differencing(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(read_table(spark, folder, "pages"))


@query
def op2_pack_ffd(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read_table(spark, folder, "documents"))


@query
def op3_simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(read_table(spark, folder, "documents"))


@query
def op4_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    ratings = read_table(spark, folder, "labels").withColumn("grade", rating())
    return grade(docs, fit_ordinal(docs, ratings, n_grades=3))


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = shared_path(spark, "warc")
    write_warc(page_records(read_table(spark, folder, "pages")), archive)
    page = lambda c: F.regexp_extract(c, r"^urn:x-page:(.*)$", 1).try_cast("long")
    stored = read_warc(spark, archive, payload=True).where("record_type = 'response'")
    stored = stored.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}).drop("payload")
    revisits = read_warc(spark, archive).where("record_type = 'revisit'").drop("payload")
    return stored.unionByName(revisits).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


SQL["op5_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS b FROM pages
), s AS (
  SELECT page_id, strlen(b) AS payload_bytes, sha256(b) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM s
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return quality_report(docs, fit_rules(docs, read_table(spark, folder, "labels")))


@query
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(read_table(spark, folder, "documents"), digest_all=True)


SQL["op7_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""


def source_domain() -> Column:
    """The domain of a source: by the number in its name, web below 8, books below 14, reference above; else other."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)$", 1).try_cast("int")
    return F.when(number < 8, "web").when(number < 14, "books").when(number.isNotNull(), "reference").otherwise("other")


#: Half of all tokens: web, books and reference at 5:3:2, English at 3 to 1 of each other language, sources alike.
CORPUS_MIX = Mix(
    levels=("domain", "lang", "source"),
    weights={("web",): 5.0, ("books",): 3.0, ("reference",): 2.0, ("web", "en"): 3.0, ("books", "en"): 3.0, ("reference", "en"): 3.0},
)


@query
def op8_mix_budgets(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, folder, "documents"), CORPUS_MIX, level_columns={"domain": source_domain()})
    return mixed.select("doc_id", source_domain().alias("domain"), "lang", "source", "n_tokens", "epoch")


@query
def op9_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = fit_languages(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "langs", "shares")


@query
def op10_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    done = drop_repeated_lines(read_table(spark, folder, "documents"))
    return done.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align(read_table(spark, folder, "documents"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """Documents whose text repeats from some word on, where crc32 of the id, h, is a multiple of 10: each word from
    a = g % n on becomes word a + (i - a) % p, for g = h / 10 and p = 1 + (n - a) / (3 + g % 8), rounded down."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("words")
    start = F.pmod(g, F.greatest(n, F.lit(1)))
    period = 1 + F.floor((n - start) / (3 + g % 8))
    there = F.expr("transform(sequence(0, size(words) - 1), i -> words[cast(if(i < _a, i, _a + (i - _a) % _p) as int)])")
    words = F.filter(F.split("text", WHITE), lambda w: w != "")
    chosen = docs.withColumn("words", F.when(h % 10 == 0, words)).withColumns({"_a": start, "_p": period})
    return chosen.withColumn("text", F.when(n > 0, F.array_join(there, " ")).otherwise(F.col("text"))).select("doc_id", "text")


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_planted_period(read_table(spark, folder, "documents").select("doc_id", "text"))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("o"), r["start"].alias("start"), r["period"].alias("period"))))
    found = find_runs(docs).withColumn("_r", longest)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_r.start").alias("start"),
        (-F.col("_r.o")).alias("length"),
        F.col("_r.period").alias("period"),
        F.expr("(1000 * -_r.o) div _r.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


@query
def op13_quartile_digest(spark: SparkSession, folder: str) -> DataFrame:
    return against_next(read_table(spark, folder, "documents"))
