"""Every query by name, with the SQL that states its result."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, folder) function under a name, with its SQL where it has one."""

    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt to all cores, where their files are fewer scan tasks than that: for small tables with much work for each row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if rows.rdd.getNumPartitions() < 2 * cores else rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")
