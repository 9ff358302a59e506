"""Keeping tables up to date: the table that a merge leaves, as a plan. A caller writes it where it wants."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.ranking import best_by


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Last wins: for each key the changes' row with the highest version (of equal ones, one chosen by its hash; null is the
    lowest), else the target's row."""
    newest = best_by(changes.withColumn("_v", version), keys, [F.struct(F.col("_v").isNull(), -F.col("_v"), F.xxhash64(*changes.columns))]).drop("_v")
    return target.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def insert_new(target: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First wins: the target, and the changes' first row for each key that it lacks."""
    first = best_by(changes.join(target.select(*keys), keys, "left_anti"), keys, order)
    return target.unionByName(first)


def replace_children(target: DataFrame, children: DataFrame, parent: str) -> DataFrame:
    """The target with all rows of the children's parents replaced."""
    return target.join(children.select(parent).distinct(), parent, "left_anti").unionByName(children)


def update_columns(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The target with new values where an update has one."""
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
