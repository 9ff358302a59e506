"""Stored tables: their definitions, manifests that grow, and files that are replaced as a whole."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import canonical_key
from corvane.operators.merge import update_columns, upsert
from corvane.session import settle
from corvane.sources.records import FETCH

# The stored tables with their columns.
TABLES = {
    "statutes": "id string, jurisdiction_code string, jurisdiction_name string, code_name string, law_code string, section_number string, canonical_citation string, title string, statute_language string, "
    "complete_statute string, plain_english_summary string, source_url string, source_name string, created_at timestamp, updated_at timestamp, factors array<string>",
    "documents": "id bigint, source_url string, fetched_at string, raw_text string, metadata string",
    "chunks": "id bigint, doc_id bigint, chunk_idx int, text string, embedding array<float>, char_start int, char_end int",
    "extractions": "id bigint, doc_id bigint, schema_name string, data string, source_quote string, source_char_start int, source_char_end int, extracted_at string",
    "collections": "id bigint, name string, created_at timestamp",
    "collection_items": "collection_id bigint, doc_id bigint, note string, added_at timestamp",
    "fetch_manifest": FETCH,
}
#: What a table is laid out by: a point lookup or a filter on it reads a part of the files.
PARTITIONS = {"statutes": "jurisdiction_code", "extractions": "schema_name"}


def create_tables(spark: SparkSession, database: str) -> None:
    """The database and those of its tables that aren't there yet, as Parquet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        by = f" PARTITIONED BY ({PARTITIONS[name]})" if name in PARTITIONS else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{by}")


def statute_id(jurisdiction: str, code: str, section: str):
    """The id of a statute: its place, so that every load gives the same one."""
    return canonical_key(F.col(jurisdiction), F.col(code), F.col(section), lower=True)


def append_manifest(records: DataFrame, folder: str) -> None:
    """Add records to a manifest of JSON lines; a failed job adds nothing that readers see."""
    records.write.mode("append").json(folder)


def swap_in(table: DataFrame, folder: str) -> None:
    """Replace a Parquet folder by a table that may read it: the new files are complete before the old ones move to
    <folder>.bak. Between the two renames the folder isn't there: readers that start then fail and have to try again."""
    spark = table.sparkSession
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    path, new, old = (jvm.org.apache.hadoop.fs.Path(folder + end) for end in ("", ".new", ".bak"))
    system = path.getFileSystem(hadoop)
    table.write.mode("overwrite").parquet(folder + ".new")
    if system.exists(path):
        system.delete(old, True)
        system.rename(path, old)
    system.rename(new, path)


def write_index(statutes: DataFrame, cases: DataFrame, summary: DataFrame, folder: str) -> None:
    """An index of citations: edges by code, cases by year, and a summary of one row."""
    statutes.write.mode("overwrite").partitionBy("code").json(f"{folder}/by_statute")
    cases.write.mode("overwrite").partitionBy("year").json(f"{folder}/by_case")
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def write_lines(lines: DataFrame, folder: str) -> None:
    """A text file of sorted lines, such as sections that are missing."""
    column = lines.columns[0]
    lines.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(folder)


# ---- tables of which a part is rewritten

BUCKET = "_bucket"


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(table: DataFrame, folder: str, keys: list[str], buckets: int) -> None:
    """A table in `buckets` folders by a hash of its keys, so that a change of some keys rewrites the folders of those only."""
    placed = table.withColumn(BUCKET, _bucket(keys, buckets)).hint("rebalance", BUCKET)
    placed.write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
    table.sparkSession.createDataFrame([(buckets, keys)], "buckets int, keys array<string>").coalesce(1).write.mode("overwrite").json(f"{folder}/_layout")


def read_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop(BUCKET)


def rewrite_buckets(folder: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Replace the rows of the buckets that hold the keys of `touched` by `change` of them; the buckets' numbers. Files of others
    aren't read or written. The new rows are complete before any old file goes; the buckets are then replaced one by one, and
    a failure in between leaves some old and some new. `change` has to keep each row's keys within their buckets."""
    spark = touched.sparkSession
    layout = spark.read.json(f"{folder}/_layout").first()
    buckets = [r.b for r in touched.select(_bucket(layout.keys, layout.buckets).alias("b")).distinct().collect()]  # as many as buckets at most
    if not buckets:
        return []
    held = spark.read.parquet(folder).where(F.col(BUCKET).isin(buckets)).drop(BUCKET)
    new = settle(change(held).withColumn(BUCKET, _bucket(layout.keys, layout.buckets)), "buckets")
    strays = new.where(~F.col(BUCKET).isin(buckets))
    if not strays.isEmpty():
        raise ValueError("the change has keys of other buckets than those touched")
    new.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(folder)
    left = {r[BUCKET] for r in new.select(BUCKET).distinct().collect()}
    for gone in set(buckets) - left:  # a bucket without rows isn't written, so its old files have to go
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{BUCKET}={gone}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return sorted(buckets)


def replace_children_in(folder: str, children: DataFrame, parent: str, gone: DataFrame | None = None) -> list[int]:
    """Replace all rows of the children's parents in a table that is laid out by them; parents in `gone` lose theirs."""
    parents = children.select(parent) if gone is None else children.select(parent).unionByName(gone.select(parent))
    return rewrite_buckets(folder, parents, lambda held: held.join(parents.distinct(), parent, "left_anti").unionByName(children))


def update_columns_in(folder: str, updates: DataFrame, key: str, columns: list[str]) -> list[int]:
    """Set columns of rows by key where an update has a value; keys that the table lacks are left out."""
    return rewrite_buckets(folder, updates, lambda held: update_columns(held, updates, key, columns))


def upsert_in(folder: str, changes: DataFrame, keys: list[str], version: Column) -> list[int]:
    """Last wins, in the buckets of the changes' keys."""
    return rewrite_buckets(folder, changes, lambda held: upsert(held, changes, keys, version))
