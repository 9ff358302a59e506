"""What several operators share: settled intermediate tables, white space, names of columns, and table reading."""

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import settle, shared_path, ship

__all__ = ["WHITE", "free_name", "local_path", "one_space", "read_table", "settle", "shared_path", "without"]

#: ASCII white space, as a Java and RE2 pattern.
WHITE = r"[\x20\x09-\x0D]+"

def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def one_space(text: str) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI or of a path without a scheme; None for any other store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return os.fspath(uri) if "://" not in uri else None


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(columns: list[str], *made: str) -> list[str]:
    """The columns that an operator's own ones of these names don't replace."""
    return [c for c in columns if c.lower() not in {m.lower() for m in made}]
