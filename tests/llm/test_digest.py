import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import digest as module
from corvane.llm.digest import BUCKETS, STRANGERS, against_next, as_text, bucket_counts, digest, fingerprint, from_text, likeness, likeness_of
from corvane.llm.queries import QUERIES


def bucket(b):
    """The bucket of three bytes, in whole numbers."""
    cut = 0xFFFFFFFF
    h = ((b[0] * 0x9E3779B1 & cut) ^ (b[1] * 0x85EBCA77 & cut) ^ (b[2] * 0xC2B2AE3D & cut)) * 0x27D4EB2F & cut
    h = (h ^ h >> 15) * 0x85EBCA77 & cut
    return h >> 22


def plain_digest(text):
    data = text.encode()
    padded = b"\0\0" + data + b"\0\0"
    counts = [0] * BUCKETS
    for i in range(len(padded) - 2 if data else 0):
        counts[bucket(padded[i : i + 3])] += 1
    quartiles = [sorted(counts)[BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    return [sum(c > q for q in quartiles) for c in counts]


@settings(max_examples=40, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=200))
def test_levels_equal_brute_force(text):
    levels = digest(text)
    assert levels[1:].tolist() == plain_digest(text)
    assert from_text(as_text(levels)).tolist() == levels.tolist()


def test_long_texts_are_counted_in_pieces(monkeypatch):
    data = "some words that go on and on, é. ".encode() * 50
    whole = bucket_counts(data)
    monkeypatch.setattr(module, "_AT_ONCE", 7)
    assert (bucket_counts(data) == whole).all() and whole.sum() == len(data) + 2


def test_likeness_is_bounded_and_falls_with_edits():
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefghilmnoprstuy") for _ in range(rng.randint(2, 8))) for _ in range(300))
    a, b = text(), text()
    shares = [likeness_of(digest(a), digest(a[: len(a) * k // 10] + b[len(a) * k // 10 : len(a)])) for k in range(0, 11)]
    assert shares[-1] == 1.0 and shares[0] < 0.4 and all(a < b + 0.05 for a, b in zip(shares, shares[1:])) and all(0 <= s <= 1 for s in shares)
    assert likeness_of(digest(""), digest("")) == 1.0 and likeness_of(digest(""), digest("a")) == 0.0 and likeness_of(digest("a"), digest("b")) < 1
    far = [np.r_[9, np.full(BUCKETS, k)].astype(np.uint8) for k in (0, 3)]
    assert likeness_of(*far) == 0.0 and STRANGERS < 6


def test_columns(docs_of):
    docs = docs_of([(1, "same text"), (2, "same text"), (3, None), (4, "")])
    got = {r.doc_id: r.f for r in docs.select("doc_id", fingerprint(F.col("text")).alias("f")).collect()}
    assert got[1] == got[2] != got[3] == got[4] and len(got[1]) == 2 + BUCKETS // 2
    pairs = docs.select("doc_id", fingerprint(F.col("text")).alias("f")).withColumn("s", likeness(F.col("f"), F.lit(got[1])))
    assert {r.doc_id: r.s for r in pairs.collect()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}
    assert pairs.select(likeness(F.col("f"), F.lit(None).cast("string")).alias("s")).where("s IS NOT NULL").count() == 0


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for i, (key, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        own, changed, other = digest(text), digest(edited), digest(following)
        yield key, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(changed), likeness_of(own, changed), likeness_of(own, other)


ROWS = [(i * 7 % 101, None if i % 13 == 0 else "" if i % 11 == 0 else f"document {i} é🙂 " * (i % 23)) for i in range(101)] + [(500, "one long text " * 20_000)]


@pytest.mark.parametrize("partitions", ["1", "4", "150"])
def test_next_rows_equal_brute_force(spark, docs_of, partitions):
    docs = docs_of(ROWS).withColumnsRenamed({"lang": "part", "source": "role"})
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = against_next(docs).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == sorted(expected(ROWS))


def test_repeated_rows_null_ids_and_small_tables(docs_of):
    got = against_next(docs_of([(1, "b c d")] * 50 + [(None, "x y z")] * 3 + [(2, "q")])).collect()
    assert len(got) == 54 and sum(r.doc_id is None for r in got) == 3
    assert sum(r.near_next == 1.0 for r in got) == 49 + 2
    only = against_next(docs_of([(7, "alone here")])).first()
    assert only.near_next == 1.0 and only.edited_sha256 == hashlib.sha256(b"alone h" + b"alo").hexdigest()
    assert against_next(docs_of([])).count() == 0


def test_query(spark, docs_of, tmp_path):
    docs_of(ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["op13_quartile_digest"](spark, str(tmp_path)).collect())) == sorted(expected(ROWS))
