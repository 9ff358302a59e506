"""Walks over a graph of links, level by level."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def walk(start: DataFrame, expand: Callable[[DataFrame], DataFrame], keys: list[str], folder: str, most_levels: int = 100) -> DataFrame:
    """(keys, depth, parent: struct of keys, and the other columns of what `expand` gives): all that can be reached from `start`,
    each key once, at its least depth and below its smallest parent there.

    `expand` gets the rows of a level and returns what they lead to: the keys, `parent` (a struct of the parent's keys), and
    any other columns. It may join a table of links, or fetch pages. Each level is written to the folder before the next is
    looked at, so a walk that was stopped goes on from its last whole level, and lost executors cost one level at most.
    What is known grows by a level's keys at a time, by an anti-join. `start` has the keys and may have the other columns.
    ValueError if there is more after `most_levels` levels.
    """
    spark = start.sparkSession
    parent = F.lit(None).cast("struct<" + ",".join(f"{k}:{start.schema[k].dataType.simpleString()}" for k in keys) + ">")
    level = start.dropDuplicates(keys)
    if "parent" not in level.columns:
        level = level.withColumn("parent", parent)
    known = None
    for depth in range(most_levels + 1):
        path = f"{folder}/depth={depth}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            level.write.mode("overwrite").parquet(path)
        done = spark.read.parquet(path)
        if done.isEmpty():
            return known
        known = done.withColumn("depth", F.lit(depth)) if known is None else known.unionByName(done.withColumn("depth", F.lit(depth)), allowMissingColumns=True)
        found = expand(done)
        rest = [c for c in found.columns if c not in (*keys, "parent")]
        first = found.groupBy(*keys).agg(F.min_by(F.struct("parent", *rest), F.struct("parent", *rest)).alias("_f"))
        level = first.join(known.select(*keys), keys, "left_anti").select(*keys, "_f.*")
    raise ValueError(f"there is more after {most_levels} levels")
