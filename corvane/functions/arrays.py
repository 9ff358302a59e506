"""Arrays, maps and JSON."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags of statutes; the last one stands alone.
FACTORS = (
    "Improper Turning", "Improper Passing", "Failure to Yield the Right-of-Way", "Improper Lane of Travel", "Improper Stopping", "DUI/DWI", "Fleeing the Scene of a Collision",
    "Failure to Maintain Lane", "Driving Too Fast For Conditions", "Using a Wireless Telephone/Texting While Driving", "Fleeing a Police Officer", "Failure to Obey Traffic Control Device",
    "Following Too Closely", "Failure to Yield at a Yield Sign", "Improper Starting", "Reckless Driving", "Failure to Use/Activate Horn", "Other",
)
OTHER = FACTORS[-1]


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """What `make` gives for a value that is worked out once, however often `make` reads it: the bodies of lambdas are interpreted, and
    what they repeat is done again each time."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def first_of_each(items: Column, key: str) -> Column:
    """The items whose key (a field) no item before them has, in order; those with a null key go. Sorted by key, so that a long list
    isn't searched for each of its items."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(x[key].alias("k"), i.alias("i"), x.alias("x"))))
    new = lambda s: F.filter(s, lambda e, i: e["k"].isNotNull() & ~F.equal_null(F.get(s, i - 1)["k"], e["k"]))
    placed = F.sort_array(F.transform(bound(keyed, new), lambda e: F.struct(e["i"], e["x"])))
    return F.transform(placed, lambda e: e["x"])


def csv_items(text: Column) -> Column:
    """The trimmed, non-empty items of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def valid_tags(raw: Column, most: int = 3, allowed: tuple[str, ...] = FACTORS, other: str = OTHER) -> Column:
    """Known tags, trimmed, each once, at most `most` of them; then `other` goes if a specific tag is there, and stands
    for an empty or null list."""
    known = F.filter(F.transform(F.array_compact(raw), lambda x: F.trim(x)), lambda x: F.array_contains(strings(*allowed), x))
    some = F.array_remove(F.slice(F.array_distinct(known), 1, most), other)
    return F.when(F.coalesce(F.size(some), F.lit(0)) > 0, some).otherwise(strings(other))


def append_distinct(*values: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*values)))


def add_missing(old: Column, new: Column) -> Column:
    """A map with the entries of another that it lacks."""
    return F.map_concat(F.map_filter(new, lambda k, v: ~F.map_contains_key(old, k)), old)


def without_blanks(entries: Column) -> Column:
    return F.map_filter(entries, lambda k, v: v.isNotNull() & (v != ""))


def json_in(text: Column) -> Column:
    """The part of a chatty answer from its first brace to its last; null if that is no JSON object."""
    part = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(part).isNotNull() & (part != ""), part)


def json_map(text: Column) -> Column:
    """JSON text as a map of strings; null and broken text give an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.map_from_arrays(strings(), strings()))
