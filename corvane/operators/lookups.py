"""Lookups around an index of citations, search hits and projects, over tables that the caller names the columns of."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.joins import prefix_key


def hits_by(hits: DataFrame, rows: DataFrame, on: list[str], answer: list[str], at: str, id_col: str, most: int) -> DataFrame:
    """(answer, id, first): the rows that an answer's hits name by a column that both have (such as their URL), each once, at the place
    of its first hit, and of each answer the first `most`. Each task keeps so many of an answer before they meet."""
    found = hits.join(rows.select(*on, id_col), on).groupBy(*answer, id_col).agg(F.min(at).alias("first"))
    place = F.row_number().over(Window.partitionBy(*answer).orderBy("first", id_col))
    return found.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def with_rows(hits: DataFrame, rows: DataFrame, on: list[str], defaults: dict[str, Column]) -> DataFrame:
    """All hits with columns of the rows that they name; a hit without a row stays, with the defaults."""
    joined = hits.join(rows.select(*on, *defaults), on, "left")
    return joined.select(*hits.columns, *(F.coalesce(c, d).alias(c) for c, d in defaults.items()))


def first_child(parents: DataFrame, children: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The parents, each with the columns of its first child by an order (ties by the columns themselves); those without children go."""
    first = children.groupBy(key).agg(F.min(F.struct(order, *columns)).alias("_c"))
    return parents.join(first, key).select(*parents.columns, F.col(f"_c.{order}").alias(order), *(F.col(f"_c.{c}").alias(c) for c in columns if c != order))


def citing_items(asked: DataFrame, edges: DataFrame, key: str, edge_key: str, item: str, base_parts: int = 3) -> DataFrame:
    """(key, item, place): the items that cite what is asked for: place 0 for those that cite the base of the key (its first parts), 1 for
    those that cite the whole key only; each item once, at its first place. A key that is its own base has place 0 only."""
    base = F.struct(F.lit(0).alias("place"), prefix_key(F.col(key), base_parts).alias("_k"))
    keys = asked.select(key, F.inline(F.array(base, F.struct(F.lit(1).alias("place"), F.col(key).alias("_k")))))
    return keys.join(edges.select(F.col(edge_key).alias("_k"), item), "_k").groupBy(key, item).agg(F.min("place").alias("place"))


def cited_rows(edges: DataFrame, rows: DataFrame, edge_key: str, parts: list[Column], columns: list[str]) -> DataFrame:
    """Distinct edges with columns of the rows that they cite; a row's key is its parts with slashes between them."""
    keyed = rows.select(F.concat_ws("/", *parts).alias(edge_key), *columns)
    return edges.distinct().join(keyed, edge_key)


def citations_by_role(edges: DataFrame, item: str, key: str, role: Column, at: str, roles: list[str]) -> DataFrame:
    """(item, cited: array of key and role): each item's citations, each once in its best role, by role, then place, then key. Roles come
    best first; others count as the last. An item's list is gathered whole, as it is one page's."""
    rank = F.coalesce(*(F.when(role == r, i) for i, r in enumerate(roles)), F.lit(len(roles) - 1))
    best = edges.groupBy(item, key).agg(F.min(F.struct(rank.alias("r"), F.col(at).alias("p"))).alias("_b"))
    listed = best.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("_b.r", "_b.p", F.col(key).alias("key")))).alias("_l"))
    named = F.array(*[F.lit(r) for r in roles])
    return listed.select(item, F.transform("_l", lambda x: F.struct(x["key"].alias("key"), F.get(named, x["r"]).alias("role"))).alias("cited"))


def edit_projects(projects: DataFrame, edits: DataFrame) -> DataFrame:
    """The projects (id, name, items) after edits (id, at, kind, name, item), a project's in the order of `at`: create (with its name; of no
    effect on a project that is there), rename, add (an item, each once), remove, delete. Edits of a project that isn't there have no effect.
    A project's edits are gathered whole, as one person makes them; items stay in the order in which they were added."""
    item = projects.schema["items"].dataType.elementType
    none = F.array().cast(f"array<{item.simpleString()}>")
    listed = edits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "name", F.col("item").cast(item).alias("item")))).alias("_e"))
    both = projects.withColumn("_there", F.lit(True)).join(listed, "id", "full")
    state = F.struct(F.coalesce("_there", F.lit(False)).alias("there"), F.col("name").alias("name"), F.coalesce("items", none).alias("items"))

    def step(s: Column, e: Column) -> Column:
        kind, here = e["kind"], s["there"]
        made = (kind == "create") & ~here
        items = (
            F.when(made | (kind == "delete"), none)
            .when((kind == "add") & here & ~F.array_contains(s["items"], e["item"]), F.concat(s["items"], F.array(e["item"])))
            .when((kind == "remove") & here, F.array_remove(s["items"], e["item"]))
            .otherwise(s["items"])
        )
        name = F.when(made | ((kind == "rename") & here), e["name"]).otherwise(s["name"])
        return F.struct(F.when(kind == "create", True).when(kind == "delete", False).otherwise(here).alias("there"), name.alias("name"), items.alias("items"))

    done = F.aggregate(F.coalesce("_e", F.slice("_e", 1, 0), F.array().cast(listed.schema["_e"].dataType)), state, step)
    return both.select("id", done.alias("_s")).where("_s.there").select("id", "_s.name", "_s.items")
