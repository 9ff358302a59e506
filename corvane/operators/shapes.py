"""Rows of one kind shaped as rows of another: parsed sections and seed lists as statutes, documents as cards, opinions."""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import blank_to_null, clipped, squeeze, strip_tags

# Jurisdiction, law code, and their names, citation prefix and publisher.
CODE_NAMES = (
    ("CA", "VEH", "California", "Vehicle Code", "Cal. Veh. Code §", "California Legislative Information"),
    ("TX", "TN", "Texas", "Transportation Code", "Tex. Transp. Code §", "Texas Public Law"),
    ("CO", "CRS42", "Colorado", "Colorado Revised Statutes Title 42 (Vehicles and Traffic)", "Colo. Rev. Stat. §", "Colorado Public Law"),
    ("FL", "TXX", "Florida", "Florida Statutes Title XXIII (Motor Vehicles)", "Fla. Stat. §", "Florida Public Law"),
    ("NV", "NRS43", "Nevada", "Nevada Revised Statutes Title 43 (Public Safety; Vehicles; Watercraft)", "Nev. Rev. Stat. §", "Nevada Public Law"),
    ("OR", "ORS59", "Oregon", "Oregon Revised Statutes Volume 17 (Vehicle Code)", "Or. Rev. Stat. §", "Oregon Public Law"),
)
# States by name.
STATES = {"California": "CA", "New York": "NY", "Texas": "TX", "Florida": "FL", "Illinois": "IL", "Washington": "WA", "Arizona": "AZ", "Georgia": "GA"}
# An opinion's texts, the best first.
OPINION_TEXTS = ("plain_text", "html_with_citations", "html", "html_lawbox", "html_columbia")


def _clean(name: str) -> Column:
    """A field in single spaces; null if blank."""
    return F.nullif(squeeze(F.col(name)), F.lit(""))


def parsed_to_statutes(parsed: DataFrame) -> DataFrame:
    """Parsed sections (section_num, jurisdiction, law_code, code_name, section_name, title, chapter_title, article_title, text,
    source_url) as rows of statutes. Sections without a number go; missing jurisdictions and codes are CA and VEH."""
    rows = parsed.withColumns({"_section": _clean("section_num"), "_j": F.coalesce(_clean("jurisdiction"), F.lit("CA")), "_law": F.coalesce(_clean("law_code"), F.lit("VEH"))})
    known = parsed.sparkSession.createDataFrame(CODE_NAMES, "_j string, _law string, _state string, _code string, _prefix string, _publisher string")
    rows = rows.where("_section is not null").join(F.broadcast(known), ["_j", "_law"], "left")  # as many rows as CODE_NAMES
    state, body = F.coalesce("_state", "_j"), F.coalesce(_clean("text"), F.lit(""))
    headings = F.nullif(F.concat_ws(" — ", _clean("chapter_title"), _clean("article_title")), F.lit(""))
    return rows.select(
        F.col("_j").alias("jurisdiction_code"), state.alias("jurisdiction_name"), F.coalesce(_clean("code_name"), "_code", "_law").alias("code_name"), F.col("_law").alias("law_code"),
        F.col("_section").alias("section_number"), F.concat_ws(" ", F.coalesce("_prefix", F.concat_ws(" ", "_j", "_law", F.lit("§"))), "_section").alias("canonical_citation"),
        F.coalesce(_clean("section_name"), _clean("title"), headings).alias("title"), F.nullif(F.left(body, F.lit(500)), F.lit("")).alias("statute_language"), body.alias("complete_statute"),
        F.coalesce(_clean("source_url"), F.lit("")).alias("source_url"), F.coalesce("_publisher", F.concat(state, F.lit(" statutes"))).alias("source_name"),
    )


def seed_to_statutes(seeds: DataFrame, section_url: Column) -> DataFrame:
    """Rows of a seed list, with the list's own headings, as rows of statutes; `section_url` is for rows without a URL."""
    given = lambda *names: F.coalesce(*(blank_to_null(F.col(f"`{n}`")) for n in names))
    section, url = F.trim("`Section #`"), F.coalesce(blank_to_null(F.col("`Source URL`")), section_url)
    return seeds.select(
        F.coalesce(given("Jurisdiction"), F.lit("CA")).alias("jurisdiction_code"), F.coalesce(given("State"), F.lit("California")).alias("jurisdiction_name"),
        F.coalesce(given("Code", "Statute"), F.lit("Vehicle Code")).alias("code_name"), F.nullif(F.regexp_extract(url, r"[?&]lawCode=([A-Za-z]+)", 1), F.lit("")).alias("law_code"),
        section.alias("section_number"), F.coalesce(given("Canonical Citation", "Statute"), F.concat(F.lit("Cal. Veh. Code § "), section)).alias("canonical_citation"),
        given("Topic / Working Title", "Statute").alias("title"), given("Statute Language").alias("statute_language"), F.coalesce(given("Complete Statute"), F.lit("")).alias("complete_statute"),
        given("Injury Relevance Reason").alias("plain_english_summary"), url.alias("source_url"),
    )


def document_card(docs: DataFrame) -> DataFrame:
    """Documents (id, raw_text, source_url, fetched_at, meta: map, predicted: array of categories) as cards. Uploads are
    shown by their file name, others by their section; the card's factors are the gold category, then predicted ones."""
    m = lambda key: blank_to_null(F.col("meta")[key])
    upload, state, section, cited, gold = m("upload").isNotNull(), m("state"), m("section"), F.coalesce(m("citation"), F.lit("")), m("category_gold")
    known = F.coalesce(*(F.when(state == name, code) for name, code in STATES.items()), F.upper(F.left(state, F.lit(2))), F.lit("??"))
    factors = F.array_distinct(F.array_compact(F.concat(F.array(gold), F.coalesce("predicted", F.array().cast("array<string>")))))
    slug = F.lower(F.translate(section, "(.)", "--"))
    number = F.col("id").cast("string")
    return docs.select(
        F.when(upload, F.concat(F.lit("upload-"), number)).otherwise(F.concat(F.lower(known), F.lit("-vc-"), F.coalesce(slug, number))).alias("id"),
        F.when(upload, "DOC").otherwise(known).alias("jurisdiction"), F.when(upload, "Uploaded").otherwise(F.coalesce(state, known)).alias("label"),
        F.when(upload, "Uploaded Document").when(F.contains(cited, F.lit("Veh")), "Vehicle Code").otherwise(F.coalesce(m("citation"), F.lit("Code"))).alias("code"),
        F.when(upload, F.coalesce(m("filename"), F.lit("—"))).otherwise(F.coalesce(section, F.lit(""))).alias("section"),
        F.when(upload, F.coalesce(m("filename"), F.lit("Uploaded document"))).otherwise(F.coalesce(gold, m("statute_name"), F.concat(F.lit("§ "), F.coalesce(section, F.lit(""))))).alias("title"),
        F.left(F.split_part(F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"^\s+", ""), F.lit("\n"), F.lit(1)), F.lit(240)).alias("summary"),
        F.when(upload & (F.size(factors) == 0), F.array(F.lit("Uploaded Document"))).otherwise(factors).alias("factors"),
        F.when(upload, "User upload").when(F.contains(cited, F.lit("Cal")), "California Legislative Information").otherwise("Legislature").alias("publisher"),
        F.left(F.coalesce("fetched_at", F.lit("")), F.lit(10)).alias("last_verified"),
    )


def statute_card(statutes: DataFrame, now: Column) -> DataFrame:
    """Rows of statutes as the second service shows them; a row without an update time was verified on day one. `now` is
    when the cards were made, a parameter so that results can be repeated."""
    return statutes.select(
        F.col("id").cast("string").alias("id"), F.coalesce(F.nullif("title", F.lit("")), "canonical_citation").alias("title"), F.coalesce(F.nullif("plain_english_summary", F.lit("")), "statute_language", F.lit("")).alias("summary"),
        F.coalesce(F.nullif("source_name", F.lit("")), F.lit("Unknown")).alias("publisher"), F.coalesce(F.date_format("updated_at", "yyyy-MM-dd"), F.lit("1970-01-01")).alias("last_verified"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("made_at"),
    )


def opinion_document(hits: DataFrame, base: str = "https://www.courtlistener.com", least: int = 200) -> DataFrame:
    """Search hits with an opinion's texts as documents: url, the first text of over `least` characters, without tags if it
    has some at its beginning, and what the hit says."""
    best = F.coalesce(*(F.when(F.length(t) > least, F.col(t)) for t in OPINION_TEXTS), F.lit(""))
    url = F.nullif("absolute_url", F.lit(""))
    full = F.when(url.startswith("http"), url).otherwise(F.coalesce(F.concat(F.lit(base), url), F.concat(F.lit(f"{base}/opinion/"), F.col("cluster_id"), F.lit("/"))))
    return hits.select(
        "cluster_id", full.alias("source_url"), F.when(F.contains(F.left(best, F.lit(200)), F.lit("<")), strip_tags(best)).otherwise(best).alias("text"),
        F.trim(F.coalesce("case_name", F.lit(""))).alias("case_name"), F.trim(F.coalesce("court", F.lit(""))).alias("court"),
    )


def any_amount(*amounts: str) -> Column:
    """Whether one of several amounts is there and not zero."""
    return F.greatest(*(F.coalesce(F.col(a) != 0, F.lit(False)).cast("int") for a in amounts), F.lit(0)) == 1


def richer_wins(hits: DataFrame, key: str, order: str, full: str) -> DataFrame:
    """One row for each key, at the place of its first hit: the first full row, else the first row."""
    width = [c for c in hits.columns if c not in (key, order)]
    first = F.struct((~F.col(full)).alias("_short"), F.col(order).alias("_at"))
    return hits.groupBy(key).agg(F.min(order).alias(order), *(F.min_by(c, first).alias(c) for c in width))


def section_list(listed: DataFrame | None = None, span: tuple[int, int] | None = None, known: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """The distinct sections to fetch: those listed, else the whole numbers of a span, else known ones and those of
    curated spans (lo, hi) together."""
    if listed is not None:
        return listed.select(F.trim("section").alias("section")).where("section <> '' and section not like '#%'").distinct()
    numbers = lambda df: df.select(F.explode(F.transform(F.sequence("lo", "hi"), lambda n: n.cast("string"))).alias("section"))
    if span is not None:
        return numbers(SparkSession.active().range(1).select(F.lit(span[0]).alias("lo"), F.lit(span[1]).alias("hi")))
    return known.select("section").unionByName(numbers(spans)).distinct()


def error_samples(df: DataFrame, failed: Column, message: Column, order: str, most: int = 5) -> DataFrame:
    """The first failures, by order: a top-k report."""
    return df.where(failed).orderBy(order).limit(most).select(order, message.alias("message"))


def vector_literal(vector: Column, places: int = 8) -> Column:
    """A vector as the text "[a,b,...]" with so many decimals, rounded as C rounds."""

    def write(vectors: pd.Series) -> pd.Series:
        # Python rounds the number itself, a tie to the even digit, as C does; Java rounds its shortest decimals, a tie upwards
        form = f"%.{places}f"
        return vectors.map(lambda v: None if v is None else "[" + ",".join(form % x for x in v if x is not None) + "]")

    return F.pandas_udf(write, "string")(F.filter(vector, lambda x: x.isNotNull()))


def comparables(extractions: DataFrame, documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(extraction_id, id, citation, jurisdiction, year, kind, award) of verdicts with an amount, by the documents they were found in; verdicts whose
    document is gone are left out. Extractions have extraction_id, the document's id and the verdict's fields; documents have
    date_filed.

    The citation is the verdict's, else the day of filing in brackets, else the case's name; the year is that of the filing, else of
    the decision; the award is the total, else the sum of its parts.
    """
    amount = F.coalesce(F.nullif("total_amount_usd", F.lit(0.0)), F.coalesce("compensatory_amount_usd", F.lit(0.0)) + F.coalesce("punitive_amount_usd", F.lit(0.0)))
    rows = extractions.withColumn("award", amount).where("award <> 0").join(documents.select(id_col, "date_filed"), id_col)
    filed, year = blank_to_null(F.col("date_filed")), lambda c: F.left(c, F.lit(4)).try_cast("int")
    kind = F.when(F.contains(F.lower(F.coalesce("award_type", F.lit(""))), F.lit("settle")), "settlement").otherwise("verdict")
    cited = F.coalesce(blank_to_null(F.col("citation")), F.concat(F.lit("("), filed, F.lit(")")), blank_to_null(F.col("case_name")), F.lit("Unknown case"))
    return rows.select("extraction_id", id_col, cited.alias("citation"), blank_to_null(F.col("jurisdiction")).alias("jurisdiction"), F.coalesce(year(filed), year(F.col("decision_date"))).alias("year"), kind.alias("kind"), "award")


def projects_with(projects: DataFrame, item: Column, items: str = "items") -> DataFrame:
    """The projects that hold an item."""
    return projects.where(F.array_contains(items, item))


def saved_items(projects: DataFrame, items: str = "items") -> DataFrame:
    """(item): what any project holds, once."""
    return projects.select(F.explode(items).alias("item")).distinct()


def project_rows(projects: DataFrame, rows: DataFrame, id_col: str, project: str = "id", items: str = "items", at: str = "position") -> DataFrame:
    """The rows that projects hold, with their project and place in it; items without a row are left out. An item of many projects is
    joined as often as it is held, by a plain join that adaptive execution splits."""
    held = projects.select(F.col(project).alias("project"), F.posexplode(items).alias(at, id_col))
    return held.join(rows, id_col)


def result_texts(hits: DataFrame, answer: list[str], order: list[str], found: Column, lines: list[Column], lead: Column) -> DataFrame:
    """(answer, n, text): each answer's hits as one text for a tool: `found` (of the number of hits, `n`), then a block for each hit in
    order, numbered from 1: "[1] " and its lead, and below it those of its lines that aren't null, four spaces in. Blocks are
    parted by blank lines. Give it the best hits of each answer only, as all of one answer's are gathered."""
    below = F.array_compact(F.array(*lines))
    block = F.struct(*order, lead.alias("_lead"), below.alias("_lines"))
    grouped = hits.groupBy(*answer).agg(F.array_sort(F.collect_list(block)).alias("_b"), F.count(F.lit(1)).alias("n"))
    numbered = F.transform("_b", lambda b, i: F.array_join(F.concat(F.array(F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), b["_lead"])), F.transform(b["_lines"], lambda x: F.concat(F.lit("    "), x))), "\n"))
    return grouped.select(*answer, "n", F.array_join(F.concat(F.array(found), numbered), "\n\n").alias("text"))


def statute_lines() -> tuple[Column, list[Column]]:
    """The lead and the lines of a statute in a result text: citation, else its place; id, title, factors, source, and an excerpt."""
    body = F.trim(F.coalesce("complete_statute", F.lit("")))
    place = F.trim(F.concat_ws(" ", F.coalesce("jurisdiction_code", F.lit("")), F.coalesce("code_name", F.lit("")), F.lit("§"), F.coalesce("section_number", F.lit(""))))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.nullif(value, F.lit("")))
    excerpt = F.concat(F.lit("excerpt: "), F.replace(F.left(body, F.lit(500)), F.lit("\n"), F.lit(" ")), F.when(F.length(body) > 500, "…").otherwise(""))
    lines = [F.concat(F.lit("id: "), F.col("id").cast("string")), line("title", F.trim("title")), line("factors", F.array_join("factors", ", ")), line("source", F.col("source_url")), excerpt]
    return F.coalesce(F.nullif(F.trim("canonical_citation"), F.lit("")), place), lines


def opinion_lines() -> tuple[Column, list[Column]]:
    """The same for opinions: the case's name; court, day and citations; address; and a snippet."""
    details = F.array_join(F.filter(F.array(F.trim("court"), F.left("date_filed", F.lit(10)), F.array_join("citations", ", ")), lambda x: x != ""), " · ")
    said = F.replace(F.trim(F.coalesce("snippet", F.lit(""))), F.lit("\n"), F.lit(" "))
    snippet = F.when(said != "", F.concat(F.lit("snippet: "), clipped(said, 400)))
    return F.coalesce(F.nullif(F.trim("case_name"), F.lit("")), F.lit("(no case name)")), [F.nullif(details, F.lit("")), F.concat(F.lit("URL: "), "url"), snippet]
