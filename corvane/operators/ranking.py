"""Order, top rows, and the best row of each group."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.joins import small_side
from corvane.session import settle

KEYWORD_WEIGHT = 0.6


def top_k(df: DataFrame, score: Column, key: str, k: int) -> DataFrame:
    """The k rows with the highest scores, ties by key: each task keeps k rows, and only those meet."""
    return df.withColumn("score", score).orderBy(F.desc("score"), key).limit(k)


def pool_size(k: int, filtered: bool) -> int:
    """How many candidates a re-ranking starts from."""
    return max(k * (30 if filtered else 3), 30)


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order. The rows travel as one struct under partial aggregation, so a
    group of any size is fine; `order` must be total for a defined result."""
    rank = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), rank).alias("_best"))
    return best.select("_best.*")


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """As best_by with any sort directions, by a window."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_of_equal(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with the smallest id of those with equal texts; null texts are equal to each other. Rows that repeat an id and a
    text stay together. Only ids and hashes are shuffled; texts aren't while the ids to drop are few enough to be broadcast,
    and else once, by id."""
    key = F.struct(F.col(text_col).isNull(), F.sha2(text_col, 256))
    hashes = settle(df.select(F.col(id_col).alias("_id"), key.alias("_h")), "hashes")
    first = settle(hashes.groupBy("_h").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "first-ids")  # settled, so that the join can be split
    later = settle(hashes.join(first, "_h").where(~F.col("_id").eqNullSafe(F.col("_first"))).select("_id"), "later-ids")
    dropped = small_side(later)
    return df.join(dropped, df[id_col].eqNullSafe(dropped["_id"]), "left_anti")


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """`df` with each row's place in an order, from 1. The table is sorted by ranges, so no task sees more than a range;
    a row's place is its place in its range and the rows of the ranges before (one count for each range)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = settle(ranged, "ranges")  # ranges come from a sample, and another run may draw them elsewhere
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_at", inside).join(F.broadcast(before), "_part").withColumn(into, (F.col("_at") + F.col("_before")).cast("long")).drop("_part", "_at", "_before")


def section_key(section: Column) -> Column:
    """Sort key of a section number: its numeric parts, suffix letters, and star marks. Dashed and dotted forms of all
    kinds are numbers in turn ("42-4-1801", "484B.067", "1146-a", "*1146", "545.001"); what has no leading number is
    last."""
    s = F.trim(section)
    bare = F.regexp_replace(s, r"^\*", "")
    parts = F.transform(F.regexp_extract_all(bare, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    suffix = F.upper(F.regexp_extract(bare, r"^\d+(?:[.-]\d+)*-?([A-Za-z]*)", 1))
    lead = bare.rlike(r"^\d")
    get = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(0).cast("long"))
    return F.struct(
        F.when(lead, get(0)).otherwise(F.lit(10**9).cast("long")).alias("major"), F.when(lead, get(1)).otherwise(0).alias("second"), F.when(lead, get(2)).otherwise(0).alias("third"),
        F.when(lead, suffix).otherwise("").alias("suffix"), s.startswith("*").cast("int").alias("star"), s.alias("raw"),
    )


def plain_section_key(section: Column) -> Column:
    """The narrower key: major, minor, suffix, star tail, star prefix; all other forms last."""
    s = F.trim(section)
    bare = F.when(s.startswith("*"), F.substr(s, F.lit(2))).otherwise(s)

    def halves(text: Column, mark: str) -> tuple[Column, Column, Column]:
        """What stands before and behind a mark, and whether both are as they should be: one mark at most, something on both sides."""
        parts = F.split(text, f"[{mark}]")
        behind = F.get(parts, F.lit(1))
        return F.get(parts, F.lit(0)), F.coalesce(behind, F.lit("")), (F.size(parts) == 1) | ((F.size(parts) == 2) & (behind != ""))

    digits = lambda x: F.translate(x, "0123456789", "") == ""
    head, tail, one_star = halves(bare, "*")
    number, suffix, one_dash = halves(head, "-")
    major, minor, one_point = halves(number, ".")
    ok = one_star & one_dash & one_point & (major != "") & digits(major) & digits(minor) & digits(tail) & ~F.regexp_like(suffix, F.lit("[^A-Za-z]"))
    value = lambda x: F.when(ok, F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))).otherwise(0)
    return F.struct(
        F.when(ok, value(major)).otherwise(F.lit(10**9).cast("long")).alias("major"), value(minor).alias("minor"), F.when(ok, F.upper(suffix)).otherwise("").alias("suffix"),
        value(tail).alias("tail"), F.when(ok & s.startswith("*"), 1).otherwise(0).alias("star"), s.alias("raw"),
    )
