"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import settle


def _smallest(pairs: DataFrame) -> DataFrame:
    """For each u, the smallest of itself and its v; settled, so that the join with it can split the rows of a hot u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return settle(least, "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    joined = edges.join(_smallest(edges), "u")
    leaf = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return leaf.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long); component is its smallest reachable node.

    Loops and repeated edges are harmless. Each round is settled in the shared folder, so lineage stays short. Rounds
    grow with the logarithm of the longest path; RuntimeError after `most_rounds`.
    """
    start = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = settle(start, "edges"), None
    for _ in range(most_rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            root = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root)
        mark = tuple(seen)
        now = settle(_small_star(_large_star(now)), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
