"""Joins by order, with one key that holds all rows spread over ranges."""

import random

import pytest

from corvane.operators import joins


def rows_of(seed, n, keys):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.randint(0, 60), i) for i in range(n)]


def plain_as_of(left, right):
    out = []
    for k, at, i in left:
        before = [(t, v) for j, t, v in right if j == k and t <= at and v is not None]
        out.append((k, at, i, max(before)[1] if before else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keys", [["a"], ["a", "a", "a", "b", None], [None]])
@pytest.mark.parametrize("most_rows", [0, 20, 10**9])
def test_as_of_with_hot_keys(spark, keys, most_rows):
    left, right = rows_of(1, 150, keys), [(k, t, v if v % 5 else None) for k, t, v in rows_of(2, 60, keys)]
    frames = spark.createDataFrame(left, "k string, at int, i int"), spark.createDataFrame(right, "k string, at int, v int")
    got = joins.as_of(*frames, ["k"], "at", "v", most_rows)
    assert got.columns == ["k", "at", "i", "v"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_as_of(left, right)


@pytest.mark.parametrize("keys", [["a"], ["a", "a", "a", "b", None]])
@pytest.mark.parametrize("most_rows", [0, 20, 10**9])
def test_next_greater_with_hot_keys(spark, keys, most_rows):
    rows = rows_of(3, 200, keys)
    got = joins.next_greater(spark.createDataFrame(rows, "k string, at int, i int"), ["k"], "at", "following", most_rows)
    want = [(k, at, i, min((t for j, t, _ in rows if j == k and t > at), default=None)) for k, at, i in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_hot_key_is_spread_over_ranges(spark, monkeypatch):
    seen = []

    def settled(df, label):
        if label == "ranges":
            seen.append(sorted(r["count"] for r in df.groupBy("_part").count().collect()))
        return kept(df, label)

    kept = joins.settle
    monkeypatch.setattr(joins, "settle", settled)
    rows = [("a", i, i) for i in range(4000)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = joins.next_greater(spark.createDataFrame(rows, "k string, at int, i int"), ["k"], "at", "following", 100)
        assert got.where("following = at + 1").count() == 3999
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(seen[0]) == 4 and seen[0][-1] < 1600


def test_whole_table_as_one_key(spark):
    rows = spark.createDataFrame([(i // 2, i) for i in range(40)], "at int, i int")
    got = joins.next_greater(rows, [], "at", "following", 5)
    assert sorted((r.at, r.following) for r in got.collect()) == sorted((i // 2, i // 2 + 1 if i < 38 else None) for i in range(40))
