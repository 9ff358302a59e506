"""Joins by order and range, as windows and equi-joins."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import settle


#: Rows of one key that a window takes; keys with more are spread over ranges of their order.
MOST_ROWS = 5_000_000


def _hot(df: DataFrame, keys: list[str], most_rows: int) -> DataFrame:
    """The keys with more rows than that: few, whatever the table, as each has so many rows."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > most_rows) if keys else df.agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > most_rows)
    return settle(counted.drop("_k").withColumn("_hot", F.lit(True)), "hot-keys")


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names], F.lit(True))


def _spread(df: DataFrame, keys: list[str], at: str, most_rows: int, plain, carry) -> DataFrame:
    """`plain` of the rows of usual keys, and `carry` of those of hot keys, which lie in ranges of (keys, at) numbered by `_part`:
    equal keys and times are in one range."""
    hot = _hot(df, keys, most_rows)
    if hot.isEmpty():
        return plain(df)
    marked = df.join(F.broadcast(hot), _same(df, hot, keys), "left").select(df["*"], hot["_hot"])
    usual = plain(marked.where("_hot IS NULL").drop("_hot"))
    ranged = marked.where("_hot").drop("_hot").repartitionByRange(*keys, at).withColumn("_part", F.spark_partition_id())
    ranged = settle(ranged, "ranges")  # ranges come from a sample, and another run may draw them elsewhere
    return usual.unionByName(carry(ranged).drop("_part"))


def _carried(ranged: DataFrame, keys: list[str], ends: DataFrame, value: Column, window) -> DataFrame:
    """`ranged` with `_carry`: what the other ranges of a row's key bring to its range. `ends` has a row for each range and key;
    only a range's first or last key goes on in another, so at most one row for each range is broadcast."""
    brought = ends.withColumn("_carry", value.over(window(Window.partitionBy(*keys).orderBy("_part")))).where("_carry IS NOT NULL").select("_part", *keys, "_carry")
    return ranged.join(F.broadcast(brought), _same(ranged, brought, ["_part", *keys]), "left").select(ranged["*"], brought["_carry"])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """`left` with the `value` of the last row of `right` at or before it, within the keys; null if there is none.

    One union and one window over the keys: no pairs are made. Of `right` rows at one time, the largest value counts. Keys
    with more than `most_rows` rows are spread over ranges of time: a window for each range, and the last value of the ranges
    before carried over.
    """
    both = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(*keys, at, F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    last = lambda *by: F.last("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def carry(ranged: DataFrame) -> DataFrame:
        newest = F.max(F.when(F.col("_v").isNotNull(), F.struct(at, "_v")))
        ends = ranged.groupBy("_part", *keys).agg(newest["_v"].alias("_end"))
        known = _carried(ranged, keys, ends, F.last("_end", ignorenulls=True), lambda w: w.rowsBetween(Window.unboundedPreceding, -1))
        return known.withColumn(value, F.coalesce(last("_part", *keys), "_carry")).drop("_carry")

    done = _spread(both, keys, at, most_rows, lambda df: df.withColumn(value, last(*keys)), carry)
    return done.where("_side = 1").drop("_side", "_v")


def next_greater(df: DataFrame, keys: list[str], at: str, into: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """Each row with the next larger value of `at` within the keys; null for the largest. Keys with more than `most_rows` rows are
    spread over ranges, the first value of the ranges behind carried back."""
    following = lambda *by: F.min(at).over(Window.partitionBy(*by).orderBy(at).rangeBetween(1, Window.unboundedFollowing))

    def carry(ranged: DataFrame) -> DataFrame:
        ends = ranged.groupBy("_part", *keys).agg(F.min(at).alias("_end"))
        known = _carried(ranged, keys, ends, F.first("_end", ignorenulls=True), lambda w: w.rowsBetween(1, Window.unboundedFollowing))
        return known.withColumn(into, F.coalesce(following("_part", *keys), "_carry")).drop("_carry")

    return _spread(df, keys, at, most_rows, lambda d: d.withColumn(into, following(*keys)), carry)


def in_range(points: DataFrame, spans: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Points joined with the whole-number spans [start, end) that hold them: each span lists its values, and the join is
    an equi-join. For spans that are long against the data, use in_wide_range."""
    listed = spans.where(F.col(start) < F.col(end)).withColumn(at, F.explode(F.sequence(F.col(start), F.col(end) - 1)))
    return points.join(listed, at)


def in_wide_range(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """The same for any spans: both sides go to bins of `width`, a span to each bin that it touches."""
    bins = spans.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    found = points.withColumn("_bin", F.floor(F.col(at) / width)).join(bins, "_bin").drop("_bin")
    return found.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))


def bytes_of(df: DataFrame) -> Column:
    """The sum of the sizes of all rows, as the length of their JSON."""
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))


def small_side(df: DataFrame, most_rows: int = 100_000, most_bytes: int = 32 << 20) -> DataFrame:
    """The table marked for broadcast if it has at most so many rows and bytes; else as it is, for a shuffled join. Of a
    large table so many rows are counted, without their columns; bytes are summed within each task first."""
    if df.select(F.lit(1)).limit(most_rows + 1).count() > most_rows:
        return df
    return F.broadcast(df) if df.agg(bytes_of(df)).first()[0] <= most_bytes else df


def missing_from(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present, keys, "left_anti")


def changed(left: DataFrame, right: DataFrame, keys: list[str], digest: str, status: str = "status") -> DataFrame:
    """`left` with cached, fresh or new: an equal digest on the right, another one, or none."""
    other = right.select(*keys, F.col(digest).alias("_other"), F.lit(True).alias("_there"))
    joined = left.join(other, keys, "left")
    return joined.withColumn(status, F.when(F.col("_there").isNull(), "new").when(F.col("_other").eqNullSafe(F.col(digest)), "cached").otherwise("fresh")).drop("_other", "_there")


def prefix_key(key: Column, parts: int) -> Column:
    """The first parts of a key with slashes: what turns a prefix join into an equi-join."""
    return F.substring_index(key, "/", parts)
