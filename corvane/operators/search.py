"""Filters and pages of the document search."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return min(max(default if value is None else value, low), high)


def token_filter(query: str | None, *columns: Column) -> Column | None:
    """Every white-space token of the query in at least one column, in any case; `%` and `_` are wildcards. None for a
    query without tokens."""
    tokens = [t.replace("\\", "\\\\") for t in (query or "").split()]
    each = [reduce(lambda a, b: a | b, [c.ilike(f"%{t}%") for c in columns]) for t in tokens]
    return reduce(lambda a, b: a & b, each) if each else None


def any_of(column: Column, csv: str | None) -> Column | None:
    """The column among the upper-case items of a comma-separated list; None for a list without items."""
    items = [x.strip().upper() for x in (csv or "").split(",") if x.strip()]
    return column.isin(items) if items else None


def metadata_any_of(metadata: Column, field: str, csv: str | None) -> Column | None:
    """A field of a JSON text among the items of a comma-separated list, in any case; rows without the field count as empty and
    meet no item. None for a list without items, so that it lets all rows pass."""
    return any_of(F.upper(F.coalesce(F.try_variant_get(F.try_parse_json(metadata), f"$.{field}", "string"), F.lit(""))), csv)


def overlap(tags: Column, csv: str | None) -> Column | None:
    """A tag in common with a comma-separated list; None for a list without items."""
    items = [x.strip() for x in (csv or "").split(",") if x.strip()]
    return F.arrays_overlap(tags, F.array(*[F.lit(x) for x in items])) if items else None


def where_all(df: DataFrame, *conditions: Column | None, empty_if_none: bool = False) -> DataFrame:
    """The rows that meet all conditions that aren't None. Without any: all rows, or none if `empty_if_none`."""
    some = [c for c in conditions if c is not None]
    if not some:
        return df.limit(0) if empty_if_none else df
    return df.where(reduce(lambda a, b: a & b, some))


def page_with_total(found: DataFrame, order: list, size: int) -> DataFrame:
    """The first rows in order, each with the number of all rows as `total`. The count is one row, from partial counts;
    no window gathers the rows."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(*order).limit(size).crossJoin(F.broadcast(total))  # one row


def is_section_query(query: str | None) -> bool:
    """Whether a query is a section's number, such as 22350 or 545.351, with one letter or digit in brackets behind it or not."""
    number, bracket, rest = (query or "").strip().partition("(")
    if bracket and not (len(rest) == 2 and rest[1] == ")" and rest[0].isascii() and rest[0].isalnum()):
        return False
    whole, point, part = number.partition(".")
    return whole.isdecimal() and (not point or part.isdecimal())


def statute_document(url: Column, kind: Column, upload: Column, excluded: tuple[str, ...] = ("verdict", "opinion")) -> Column:
    """Not an upload, and of no excluded kind."""
    return ~F.coalesce(url, F.lit("")).startswith("upload://") & ~F.coalesce(kind, F.lit("")).isin(*excluded) & ~F.coalesce(upload, F.lit(False))
