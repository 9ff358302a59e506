"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing to weights, packing.

Each stage takes (spark, docs, folder), works on all that the stage before it kept, and returns a DataFrame that is
written and read again as the next stage's docs.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import read_table, settle
from corvane.llm.line_dedup import drop_repeated_lines
from corvane.llm.mixing import mix_sources
from corvane.llm.near_copies import one_of_near_copies
from corvane.llm.packing import pack
from corvane.llm.quality_rules import fit_rules, keep_good
from corvane.llm.queries import CORPUS_MIX, source_domain

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that neither the base rules nor a learned rule rejects. Null and empty texts go; repeated rows stay or go
    together; whole texts are counted, however long. An empty table gives an empty one, here and in all stages."""
    return keep_good(docs, fit_rules(docs, read_table(spark, folder, "labels"))).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without later repeats of lines and passages; n_chars counts the new text and is null for a null one.
    Null and empty texts stay as they are; rows with equal id and text are one document; a null id comes first."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more.
    Texts without a word, null ones too, are copies of each other. Rows that repeat the smallest id stay together; rows with
    a null id stay if their whole group has none."""
    return one_of_near_copies(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them. Null domains, languages and sources are branches of their own; null and
    empty texts have no tokens and go with the epochs of their source; equal ids are taken or left together."""
    return mix_sources(docs, CORPUS_MIX, level_columns={"domain": source_domain()}).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences: null and empty texts are an end id, repeated rows are packed
    as often as they occur."""
    return pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates), ("mixing", mixture), ("packing", packing)]

#: Learned rules, seeded hashes and token ids are beyond SQL. Tests hold the counts, the search for a rule's conditions, line
#: dedup, near-dedup, mixing and packing each against a brute-force version, on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = settle(out, "stage") if i + 1 < len(STAGES) else out
    return docs
