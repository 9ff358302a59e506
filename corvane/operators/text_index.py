"""A substring search that skips files.

For each Parquet file of a folder, an index holds a Bloom filter of the byte trigrams of its lower-case texts: BITS bits, 128 KB
a file at most, whatever is in it. The filters are laid out by slots, a slot being the same 4,096 bits of every file, so
that a search reads the slots of its own trigrams only. A file is read if it may hold every literal piece of every token;
what is read is then filtered as ever, so the rows are those of the plain search.
"""

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.search import token_filter
from corvane.session import ship

BITS, SLOT_BITS, HASHES = 1 << 20, 1 << 12, 2
_WORDS = SLOT_BITS // 64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: Bytes that are hashed at once.
_AT_ONCE = 1 << 20


def trigram_bits(data: bytes) -> np.ndarray:
    """The bits of all byte trigrams, with repeats."""
    out = []
    for at in range(0, max(len(data) - 2, 0), _AT_ONCE):
        b = np.frombuffer(data[at : at + _AT_ONCE + 2], np.uint8).astype(np.uint64)
        codes = np.unique(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) + np.uint64(1)
        out += [codes * f >> np.uint64(44) for f in _FACTORS[:HASHES]]
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def _texts(columns: list[str]) -> Column:
    """The texts of a row in one, parted by a byte that no search has."""
    return F.lower(F.concat_ws("\x00", *columns))


def _files(spark: SparkSession, folder: str) -> list[str]:
    return [re.sub("^file:/+", "/", f) for f in spark.read.parquet(folder).inputFiles()]


def _file() -> Column:
    """The file of a row, as _files names it: local ones without their scheme, which is written in several ways."""
    return F.regexp_replace("_metadata.file_path", "^file:/+", "/")


def index_files(spark: SparkSession, folder: str, columns: list[str], index: str) -> int:
    """Add the files of a Parquet folder that the index lacks to it; the number of those. Rows of a file that is read by several
    tasks meet by file, as filters of a fixed size. Null texts have no trigrams; a folder's files are never changed in place."""
    ship(spark)
    known = set(_known(spark, index))
    new = [f for f in _files(spark, folder) if f not in known]
    if not new:
        return 0

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for file, rows in batch.groupby("file"):
                bits = held.setdefault(file, np.zeros(BITS, bool))
                bits[trigram_bits(b"\x00".join(t.encode("utf-8", "surrogatepass") for t in rows["text"]))] = True
        for file, bits in held.items():
            yield pd.DataFrame({"file": [file], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        words = reduce(np.bitwise_or, (np.frombuffer(b, "<i8") for b in parts["bits"])).reshape(-1, _WORDS)
        some = np.flatnonzero(words.any(axis=1))
        return pd.DataFrame({"file": key[0], "slot": some.astype(np.int32), "bits": [words[i] for i in some]})

    rows = spark.read.option("basePath", folder).parquet(*new).select(_file().alias("file"), _texts(columns).alias("text"))
    parts = rows.mapInPandas(collect, "file string, bits binary")
    slots = parts.groupBy("file").applyInPandas(merge, "file string, slot int, bits array<long>")
    slots.repartitionByRange("slot").sortWithinPartitions("slot", "file").write.mode("append").parquet(f"{index}/slots")
    spark.createDataFrame([(f,) for f in new], "file string").coalesce(1).write.mode("append").parquet(f"{index}/files")
    return len(new)


def _known(spark: SparkSession, index: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{index}/files")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return [r.file for r in spark.read.parquet(f"{index}/files").collect()]  # as many as the folder's listing has


def literal_pieces(query: str | None) -> list[str]:
    """What must stand in a text as it is: the tokens, in lower case, cut at wildcards."""
    return [p for token in (query or "").lower().split() for p in token.replace("_", "%").split("%") if p]


def may_hold(spark: SparkSession, index: str, query: str | None) -> DataFrame | None:
    """(file) of the indexed files that may hold every piece of a query; None if no piece has a trigram, so that none can be left
    out."""
    pieces = [p.encode("utf-8", "surrogatepass") for p in literal_pieces(query)]
    bits = np.unique(np.concatenate([trigram_bits(p) for p in pieces])) if pieces else np.empty(0, np.int64)
    if not len(bits):
        return None
    asked: dict[int, list[Column]] = {}
    for bit in bits.tolist():
        slot, inner = divmod(bit, SLOT_BITS)
        mask = 1 << (inner % 64)
        word = F.get("bits", F.lit(inner // 64)).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        asked.setdefault(slot, []).append(word != 0)
    rows = spark.read.parquet(f"{index}/slots").where(F.col("slot").isin(list(asked)))
    whole = reduce(lambda found, part: found | ((F.col("slot") == part[0]) & reduce(lambda a, b: a & b, part[1])), asked.items(), F.lit(False))
    return rows.where(whole).groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(asked)).select("file")


def files_for(spark: SparkSession, folder: str, index: str, query: str | None) -> list[str]:
    """The files of a folder that a search has to read: those that may hold the query, and those that aren't indexed yet."""
    files, possible = _files(spark, folder), may_hold(spark, index, query)
    if possible is None:
        return files
    held, known = {r.file for r in possible.collect()}, set(_known(spark, index))
    return [f for f in files if f in held or f not in known]


def skipping_search(spark: SparkSession, folder: str, columns: list[str], index: str, query: str | None) -> DataFrame:
    """The rows of a Parquet folder that have every white-space token of the query in at least one of the columns, in any case,
    `%` and `_` being wildcards: what token_filter finds, from fewer files. A query without tokens finds nothing."""
    table = spark.read.parquet(folder)
    condition = token_filter(query, *(F.col(c) for c in columns))
    if condition is None:
        return table.limit(0)
    files = files_for(spark, folder, index, query)
    if not files:
        return table.limit(0)
    return spark.read.schema(table.schema).option("basePath", folder).parquet(*files).where(condition)
