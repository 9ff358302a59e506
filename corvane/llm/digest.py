"""Fingerprints of whole documents: a digest of the quartiles that bucket counts fall in.

Every three consecutive bytes of a text are hashed to one of BUCKETS buckets. Three quartiles of the bucket counts are
found, and each bucket is written as two bits: how many of the quartiles its count exceeds. A byte for the length, in
quarter octaves, comes first. So a digest has a fixed size, does not depend on how long a text is and changes little
when a part of the text changes.

Two digests differ by the sum, over buckets, of STEP[levels apart], and by their lengths. The difference is scaled by
what unrelated texts reach and bounded: a likeness of 1 means equal digests, 0 a difference as between strangers.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import settle

BUCKETS = 1024
#: Difference of two buckets by how many levels they are apart: the farthest count more than their distance.
STEP = np.array([0, 1, 2, 6], np.int64)
#: Mean difference of a bucket at which texts count as strangers, and what a quarter octave of length beyond the first adds.
STRANGERS, LENGTH_STEP = 1.5, 0.03

_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
#: Bytes that are hashed at once, so that a very long text needs no large arrays.
_AT_ONCE = 1 << 20


def bucket_counts(data: bytes) -> np.ndarray:
    """How many byte triplets fall in each bucket. Two zero bytes before and behind make the ends of a text count too."""
    counts = np.zeros(BUCKETS, np.int64)
    if not data:
        return counts
    all_bytes = np.frombuffer(b"\0\0" + data + b"\0\0", np.uint8)
    for at in range(0, len(all_bytes) - 2, _AT_ONCE):
        b = all_bytes[at : at + _AT_ONCE + 2].astype(np.uint32)
        h = ((b[:-2] * _MIX[0]) ^ (b[1:-1] * _MIX[1]) ^ (b[2:] * _MIX[2])) * _MIX[3]
        h ^= h >> np.uint32(15)
        h *= _MIX[1]
        counts += np.bincount(h >> np.uint32(22), minlength=BUCKETS)
    return counts


def digest(text: str) -> np.ndarray:
    """The length's byte, then the level (0 to 3) of each bucket."""
    data = text.encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    quarter = BUCKETS // 4
    quartiles = np.partition(counts, [quarter - 1, 2 * quarter - 1, 3 * quarter - 1])[[quarter - 1, 2 * quarter - 1, 3 * quarter - 1]]
    levels = (counts[:, None] > quartiles).sum(axis=1)
    size = 1 + round(4 * math.log2(len(data))) if data else 0
    return np.r_[size, levels].astype(np.uint8)


def packed(levels: np.ndarray) -> bytes:
    """A digest with four buckets to a byte."""
    four = levels[1:].reshape(-1, 4)
    return bytes([levels[0]]) + (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes()


def as_text(levels: np.ndarray) -> str:
    """A digest as hexadecimal digits."""
    return packed(levels).hex()


def from_text(digits: str) -> np.ndarray:
    held = np.frombuffer(bytes.fromhex(digits), np.uint8)
    return np.r_[held[0], (held[1:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()]


def likeness_of(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 for a difference of strangers or more, and for an empty text against any other."""
    if bool(a[0]) != bool(b[0]):
        return 0.0
    levels = STEP[np.abs(a[1:].astype(np.int64) - b[1:])].sum() / (BUCKETS * STRANGERS)
    lengths = LENGTH_STEP * max(abs(int(a[0]) - int(b[0])) - 1, 0)
    return max(0.0, float(1.0 - levels - lengths))


def fingerprint(text: Column) -> Column:
    """The digest of a text column as digits; null counts as empty."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: as_text(digest(t)))

    return of(F.coalesce(text, F.lit("")))


def likeness(left: Column, right: Column) -> Column:
    """The likeness (0 to 1) of two columns of digests; null where either is."""

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else likeness_of(from_text(x), from_text(y)) for x, y in zip(a, b)], dtype="Float64")

    return of(left, right)


def spliced(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as much of the beginning of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    edited = spliced(text, following)
    changed = digest(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, packed(own), packed(changed), likeness_of(own, changed), likeness_of(own, other)


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The next row is the one with the next smaller id, and after the last comes the first again; rows with equal ids
    follow by a hash of their text, null ids come last. The edited text has its last third replaced by the beginning of
    the next text. Null texts count as empty; two empty texts are alike (1), an empty and another one aren't (0). A
    table of one row is its own next. Other columns are ignored; an empty table gives an empty result.

    Rows are dealt to ranges of ids, by their one shuffle, and each task walks its sorted range with one row of
    look-ahead, a very long text being held twice at most. The last row of a range meets the first row of the range that follows in a small join
    of two rows for each task.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"part long, role string, id {kind}, text string, {_RESULT}"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text")).withColumn("_n", F.monotonically_increasing_id())
    order = [F.desc_nulls_last("id"), F.asc("_h"), F.asc("_n")]  # equal rows may lie in several ranges, in any order

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, kept = TaskContext.get().partitionId(), None, None
        for batch in batches:
            out = []
            kept = batch["id"].dtype
            for key, text in zip(batch["id"].astype(object), batch["text"]):
                key, levels = None if pd.isna(key) else key, digest(text)
                if last is None:
                    out.append((part, "first", key, text, *[None] * 6))
                else:
                    out.append((part, "row", last[0], None, *_compared(last[1], last[2], text, levels)))
                last = key, text, levels
            yield _frame(out)
        if last is not None:
            yield _frame([(part, "last", last[0], last[1], *[None] * 6)])

    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r[i] for r in out], dtype=object) for i, n in enumerate(names)})

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    walked = settle(ranged.mapInPandas(walk, schema), "digests")
    ends = walked.where("role <> 'row'")
    parts = ends.where("role = 'first'").agg(F.sort_array(F.collect_set("part")).alias("p"))  # one number for each task
    follows = parts.select(F.posexplode("p").alias("i", "part"), "p").select("part", F.element_at("p", ((F.col("i") + 1) % F.size("p") + 1).cast("int")).alias("follows"))
    first = ends.where("role = 'first'").select(F.col("part").alias("follows"), F.col("text").alias("following"))
    pairs = ends.where("role = 'last'").select("part", "id", "text").join(follows, "part").join(first, "follows").select("id", "text", "following")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_compared(a, digest(a), b, digest(b)) for a, b in zip(batch["text"], batch["following"])]
            yield pd.concat([batch[["id"]], pd.DataFrame(found, columns=names[4:])], axis=1)

    done = walked.where("role = 'row'").select("id", *names[4:])
    done = done.unionByName(pairs.mapInPandas(compare, f"id {kind}, {_RESULT}"))
    return done.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}).withColumnRenamed("id", id_col)
