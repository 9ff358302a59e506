"""Records in and out of files: nested JSON, lines, CSV, raw pages, and JSON lines by partition. Schemas are explicit:
columns that are null in a sample would be dropped or mistyped by inference."""

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import decoded, strip
from corvane.operators.ranking import best_by, section_key

SUBSECTIONS = "array<struct<label:string,text:string,depth_em:double>>"
HISTORY = "struct<raw:string,action:string,statutes_year:int,chapter:string,section:string,bill_number:string,effective_date:string,operative_date:string>"
LEVELS = ("division", "part", "title", "chapter", "article")
SECTION = (
    "jurisdiction string, law_code string, code_name string, section_num string, section_name string, "
    + ", ".join(f"{level} string, {level}_title string" for level in LEVELS)
    + f", division_range string, chapter_range string, article_range string, node_tree_path string, text string, markdown string, subsections {SUBSECTIONS}, history {HISTORY}, "
    "op_statues string, op_chapter string, op_section string, source_url string, source_path string, content_sha256 string, parsed_at string, parser_version string"
)
FETCH = "source_slug string, jurisdiction string, law_code string, section string, url string, fetched_at string, http_status int, bytes long, content_sha256 string, raw_path string, valid boolean, error string, extra map<string,string>"

# The kinds of facts extracted from opinions, with their fields; each also has its quote.
EXTRACTIONS = {
    "CaseMetadata": "case_name string, citation string, court string, jurisdiction string, judge string, docket_number string, date_filed string, date_decided string",
    "Verdict": "case_name string, citation string, jurisdiction string, court string, plaintiff string, defendant string, award_type string, claim_type string, injury_type string, "
    "total_amount_usd double, compensatory_amount_usd double, punitive_amount_usd double, decision_date string",
    "DocketEntry": "entry_number int, date_filed string, description string, document_type string",
    "Attorney": "name string, firm string, role string, party string",
    "Citation": "case_name string, volume int, reporter string, page int, year int",
    "Injury": "injury_type string, body_part string, severity string, permanent boolean",
    "MedicalExpense": "provider string, amount_usd double, service string, date string",
    "ProductDefect": "product string, manufacturer string, defect_type string, description string",
}


def read_json_records(spark: SparkSession, folder: str, schema: str = SECTION) -> tuple[DataFrame, DataFrame]:
    """(records, broken): one JSON document per file, folders below included; broken files by path and text."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    bad = F.try_parse_json("value").isNull()
    rows = files.select("value", F.col("_metadata.file_path").alias("path"))
    good = rows.where(~bad).select(F.from_json("value", schema).alias("r"), "path").select("r.*", "path")
    return good, rows.where(bad).select("path", F.col("value").alias("text"))


def discover(records: DataFrame, jurisdiction: str | None = None, law_code: str | None = None) -> DataFrame:
    """(jurisdiction, law_code, dir): the first directory, by name, of each code; folders named jsonl don't count. With a jurisdiction or
    a code, in any case, those only."""
    for column, wanted in (("jurisdiction", jurisdiction), ("law_code", law_code)):
        records = records if wanted is None else records.where(F.upper(column) == wanted.strip().upper())
    dirs = records.select("jurisdiction", "law_code", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir")).where(~F.col("dir").rlike("/jsonl(/|$)")).distinct()
    return best_by(dirs, ["jurisdiction", "law_code"], [F.col("dir")])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, malformed ones left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): distinct lines that are neither blank nor comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return lines.where("line <> '' AND NOT startswith(line, '#')").distinct()


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; quoted values may hold line ends, commas and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)


def read_pages(spark: SparkSession, folder: str, glob: str = "*.html", first: int | None = None, order: Callable[[Column], Column] = section_key) -> DataFrame:
    """(path, section, html, sha): raw pages, decoded as UTF-8 or else Windows-1252; the section is the file's name. With `first`,
    only so many pages, the first in the order of their sections: names alone are ranked, and the contents of other files
    aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    if first is not None:
        chosen = [r.path for r in files.select("path").orderBy(order(name), "path").limit(max(first, 0)).collect()]  # a top-k of names
        if not chosen:
            return files.limit(0).select("path", name.alias("section"), F.lit("").alias("html"), F.lit("").alias("sha"))
        files = spark.read.format("binaryFile").load(chosen)
    return files.select("path", name.alias("section"), decoded(F.col("content")).alias("html"), F.sha2("content", 256).alias("sha"))


# Endings of uploads that are read as text.
TEXT_ENDINGS = ("txt", "md", "markdown", "rst", "log", "csv", "json", "htm", "html")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The paragraphs of a Word document that aren't blank, a line each; those in tables too."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open("word/document.xml") as xml:
        out = []
        for _, paragraph in ElementTree.iterparse(xml):
            if paragraph.tag == f"{_WORD}p":
                marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
                out.append("".join((e.text or "") if e.tag == f"{_WORD}t" else marks.get(e.tag, "") for e in paragraph.iter()))
                paragraph.clear()
    return "\n".join(t for t in out if t.strip()).strip()


def read_uploads(spark: SparkSession, folder: str, most_bytes: int = 25 << 20, read_pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, text, status) of uploaded files: text files, Word documents, and PDF files by a reader that the caller gives (bytes to
    the texts of pages, each put under its number). In place of a text: `empty`, `too large`, `unsupported` (a PDF without a
    reader too), `unreadable`, or `no text` (a document of pictures). Files that are too large or unsupported aren't opened;
    files of no bytes at all have no row, as the reader passes over them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.lower(F.substring_index("path", "/", -1))
    ending = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("")
    opened = ("docx", "pdf") if read_pdf else ("docx",)
    early = F.when(F.col("length") > most_bytes, "too large").when(~ending.isin("", *TEXT_ENDINGS, *opened), "unsupported")

    def extract(contents: pd.Series, endings: pd.Series) -> pd.Series:
        texts = []
        for content, kind in zip(contents, endings):
            try:
                if content is None:
                    texts.append(None)
                elif kind == "docx":
                    texts.append(docx_text(bytes(content)))
                else:
                    pages = [(i, t.strip()) for i, t in enumerate(read_pdf(bytes(content)), 1)]
                    texts.append("\n\n".join(f"--- Page {i} ---\n{t}" for i, t in pages if t))
            except Exception:  # noqa: BLE001  one broken upload must not end the job; its status says so
                texts.append(None)
        return pd.Series(texts, index=contents.index, dtype=object)

    inner = ending.isin(*opened) & early.isNull()
    text = F.pandas_udf(extract, "string").asNondeterministic()(F.when(inner, F.col("content")), ending)
    read = files.select("path", early.alias("early"), inner.alias("inner"), F.when(inner, text).when(early.isNull(), strip(decoded(F.col("content")))).alias("text"))
    status = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("text").isNull(), "unreadable").when(F.col("text") == "", F.when(F.col("inner"), "no text").otherwise("empty")).otherwise("ok")
    return read.select("path", F.when(status == "ok", F.col("text")).alias("text"), status.alias("status"))


def ranges(spark: SparkSession, spans: list[tuple[int, int]]) -> DataFrame:
    """(n): all whole numbers of inclusive spans, each once."""
    return spark.createDataFrame(spans, "lo long, hi long").select(F.explode(F.sequence("lo", "hi")).alias("n")).distinct()


def unified(sections: DataFrame) -> DataFrame:
    """Parsed sections as records of one form for all jurisdictions; empty hierarchy levels and extras are left out."""
    code, section = F.coalesce("law_code", F.lit("??")), F.coalesce("section_num", F.lit("??"))
    level = lambda name: F.struct(F.col(name).alias("ident"), F.col(f"{name}_title").alias("title"), (F.col(f"{name}_range") if f"{name}_range" in sections.columns else F.lit(None).cast("string")).alias("range"))
    hierarchy = F.map_filter(F.map_from_arrays(F.array(*[F.lit(x) for x in LEVELS]), F.array(*[level(x) for x in LEVELS])), lambda k, v: v["ident"].isNotNull())
    extras = F.map_from_arrays(F.array(*[F.lit(x) for x in ("node_tree_path", "op_statues", "op_chapter", "op_section")]), F.array("node_tree_path", "op_statues", "op_chapter", "op_section"))
    source = F.struct(
        F.col("source_url").alias("url"), F.col("source_path").alias("raw_path"), "content_sha256", "parsed_at", "parser_version", F.map_filter(extras, lambda k, v: v.isNotNull() & (v != "")).alias("metadata")
    )
    return sections.select(
        F.lower(F.concat_ws("/", F.coalesce("jurisdiction", F.lit("??")), code, section)).alias("id"), F.coalesce("jurisdiction", F.lit("??")).alias("jurisdiction"), code.alias("law_code"),
        section.alias("section"), "code_name", "section_name", hierarchy.alias("hierarchy"), "text", "markdown", "subsections", "history", source.alias("source"),
    )


def write_json_lines(records: DataFrame, folder: str, by: tuple[str, ...] = ("jurisdiction", "law_code"), order: Column | None = None) -> None:
    """JSON lines in a folder per code, in section order within each file. A code with a large share of all rows is
    spread over files by its section; the rebalance splits it."""
    ordered = records.withColumn("_order", order if order is not None else section_key(F.col("section")))
    spread = ordered.hint("rebalance", *by).sortWithinPartitions(*by, "_order").drop("_order")
    spread.write.mode("overwrite").partitionBy(*by).json(folder)


def verified(rows: DataFrame, text: str, quote: str) -> DataFrame:
    """Extractions whose quote stands in their source, with where."""
    from corvane.functions.text import quote_offset

    return rows.withColumn("place", quote_offset(F.col(quote), F.col(text))).where("place is not null").select("*", F.col("place.start").alias("source_char_start"), F.col("place.end").alias("source_char_end")).drop("place")


def parsed_extractions(rows: DataFrame, json_col: str, schema_name: str) -> DataFrame:
    """The typed fields of extractions of one kind; rows whose JSON doesn't parse or has no quote are left out."""
    schema = f"source_quote string, {EXTRACTIONS[schema_name]}"
    return rows.withColumn("data", F.from_json(json_col, schema)).where("data.source_quote is not null AND trim(data.source_quote) <> ''")
