"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then the full hash.

Only DataFrame functions run here. The first scan keeps an id, a length and a prefix hash of each row. Rows whose
length is shared are grouped again by prefix hash, and only rows that still share both are hashed in full by the second
scan. That scan must not move texts, so the surviving (length, prefix hash) pairs reach it as a sieve: a set of at most
`sieve_buckets` bucket numbers, a bound that holds for any input, which is why it may be broadcast. A row that falls in
a bucket by chance is hashed for nothing and then found alone; no decision rests on the sieve.

A hot length or a group of copies with a third of all rows is counted by partial aggregation; the joins that follow are
plain equi-joins, whose oversized partitions adaptive execution splits.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import one_space, settle

PREFIX_CHARS = 256
SIEVE_BUCKETS = 1 << 18


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, sieve_buckets: int = SIEVE_BUCKETS, digest_all: bool = False) -> DataFrame:
    """One row per row of `docs`: the id, keep_id, group_size (long), kept and text_sha256 of the normalised text.

    Texts are equal when identical after each run of ASCII white space becomes one space. Null texts count as empty
    and so equal each other. Of equal texts the row with the smallest id stays; rows that repeat this id are one
    document and all stay. A null id never wins over another; a group of null ids only keeps all of them, with a null
    keep_id. Other columns are ignored. An empty table gives an empty result. text_sha256 is null for rows that the
    refinement never had to hash, unless `digest_all` asks for it.
    """
    text = one_space(text_col)
    size, prefix = F.length("_t").cast("long"), F.xxhash64(F.substring("_t", 1, prefix_chars))
    scan = docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
    sized = settle(scan.select(size.alias("_n"), prefix.alias("_p")), "dedup-sizes")

    pairs = sized.groupBy("_n", "_p").agg(F.count(F.lit(1)).alias("_k"))  # copies are one row from here on
    by_size = pairs.groupBy("_n").agg(F.sum("_k").alias("_k")).where("_k > 1").select("_n")
    by_prefix = pairs.join(by_size, "_n", "left_semi").where("_k > 1")
    bucket = F.pmod(F.xxhash64("_n", "_p"), F.lit(sieve_buckets))
    sieve = settle(by_prefix.select(bucket.alias("_b")).distinct(), "dedup-sieve")

    read = scan.select("_id", "_t", size.alias("_n"), prefix.alias("_p")).withColumn("_b", bucket)
    read = read.join(F.broadcast(sieve.withColumn("_hit", F.lit(True))), "_b", "left")
    wanted = F.lit(True) if digest_all else F.col("_hit")
    full = settle(read.select("_id", F.coalesce("_hit", F.lit(False)).alias("_hit"), F.when(wanted, F.sha2("_t", 256)).alias("_h")), "dedup-hashes")

    hit = full.where("_hit")
    groups = settle(hit.groupBy("_h").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")  # so that the join below can be split
    found = hit.join(groups, "_h").select("_id", "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "_h")
    alone = full.where(~F.col("_hit")).select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_h")
    return found.unionByName(alone).withColumnsRenamed({"_id": id_col, "_h": "text_sha256"})
