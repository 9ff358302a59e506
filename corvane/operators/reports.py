"""Counts and ratios of the corpus."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(category, n) for each of the given values, 0 where there is none; other values don't count."""
    spark = df.sparkSession
    names = spark.createDataFrame([(v,) for v in values], "category string")
    counts = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def fetch_quality(valid: Column, error: Column, status: Column) -> Column:
    """4 valid, 3 not there (status 200), 2 other success, 1 refused, 0 failed."""
    s = F.coalesce(status, F.lit(0))
    return F.when(valid, 4).when(error.isNotNull() & (error != ""), 0).when(s == 200, 3).when(s.between(200, 399), 2).when(s.between(400, 499), 1).otherwise(0)


def count_of(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def accuracy(graded: Column, correct: Column) -> list[Column]:
    """graded, correct and pct (of the graded, to six places; null without any)."""
    return [F.count_if(graded).alias("graded"), F.count_if(graded & correct).alias("correct"), F.round(F.try_divide(100.0 * F.count_if(graded & correct), F.count_if(graded)), 6).alias("pct")]


# How the ingest of an opinion can end.
INGEST_STATUSES = ("ok", "miss", "error", "skip")


def ingest_status(text: Column, error: Column, amount: Column, seen: Column) -> Column:
    """skip without a text or when seen before, error where something failed, miss without an amount, else ok."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return F.when(blank | F.coalesce(seen, F.lit(False)), "skip").when(error.isNotNull(), "error").when(F.coalesce(amount, F.lit(0)) == 0, "miss").otherwise("ok")


def status_histogram(df: DataFrame, status: Column, statuses: tuple[str, ...] = INGEST_STATUSES) -> DataFrame:
    """(category, n) for each status, also those that don't occur."""
    return zero_filled(df.select(status.alias("status")), "status", list(statuses))


def tag_tallies(df: DataFrame, tags: Column, error: Column, other: str) -> DataFrame:
    """One row: total, specific (a tag besides the catch-all), other (the catch-all alone), errors. Failed rows count as errors only;
    rows without tags count in the total only."""
    some = F.array_distinct(F.coalesce(tags, F.array().cast("array<string>")))
    only = (F.size(some) == 1) & F.array_contains(some, other)
    fine = error.isNull() & (F.size(some) > 0)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(fine & ~only).alias("specific"), F.count_if(fine & only).alias("other"), F.count_if(error.isNotNull()).alias("errors"))


def counts_by(df: DataFrame, keys: list[str], conditions: dict[str, Column], total: str) -> DataFrame:
    """For each key the number of rows, as `total`, and of those that meet each condition."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(total), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def coverage(df: DataFrame, hit: Column, section: Column) -> DataFrame:
    """One row: n_rows, hits, the number of sections, and of sections with a hit."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("hits"), F.countDistinct(section).alias("sections"), F.countDistinct(F.when(hit, section)).alias("sections_hit"))


def graph_counts(edges: DataFrame, nodes: dict[str, str]) -> DataFrame:
    """One row: the number of distinct values of each column, by name, and of edges."""
    return edges.agg(*(F.countDistinct(c).alias(n) for n, c in nodes.items()), F.count(F.lit(1)).alias("edges"))


def consolidation_totals(df: DataFrame, source: Column, skipped: Column) -> DataFrame:
    """One row: files, records and skipped, by a second look at the rows; metrics.record_totals counts them while they are written."""
    bad = F.coalesce(skipped, F.lit(False))
    return df.agg(F.countDistinct(source).alias("files"), F.count_if(~bad).alias("records"), F.count_if(bad).alias("skipped"))
