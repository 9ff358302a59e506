from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.sources.tables import read_buckets, replace_children_in, rewrite_buckets, update_columns_in, upsert_in, write_buckets


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.createDataFrame([(i % 40, i, f"v{i}") for i in range(200)] + [(None, 900, "none")], "k long, n long, v string")
    write_buckets(rows, f"{tmp_path}/t", ["k"], 8)
    return f"{tmp_path}/t"


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def rows(spark, folder):
    return sorted(map(tuple, read_buckets(spark, folder).select("k", "n", "v").collect()), key=repr)


def test_only_touched_buckets_are_written(spark, folder):
    before, old = files(folder), rows(spark, folder)
    done = replace_children_in(folder, spark.createDataFrame([(3, 1, "new"), (3, 2, "new")], "k long, n long, v string"), "k")
    after = files(folder)
    assert len(done) == 1 and {f for f in before if f"_bucket={done[0]}/" not in f} == {f for f in after if f"_bucket={done[0]}/" not in f}
    assert all(before[f] == after[f] for f in before if f in after) and not any(f in after for f in before if f"_bucket={done[0]}/" in f)
    assert rows(spark, folder) == sorted([r for r in old if r[0] != 3] + [(3, 1, "new"), (3, 2, "new")], key=repr)


def test_a_bucket_without_rows_goes(spark, tmp_path):
    out = f"{tmp_path}/one"
    write_buckets(spark.createDataFrame([(i, i, "x") for i in range(3)], "k long, n long, v string"), out, ["k"], 1000)
    none = spark.createDataFrame([], "k long, n long, v string")
    assert len(replace_children_in(out, none, "k", gone=spark.createDataFrame([(1,), (77,)], "k long"))) == 2
    assert rows(spark, out) == [(0, 0, "x"), (2, 2, "x")] and len(files(out)) == 2


def test_updates_and_upserts(spark, folder):
    old = rows(spark, folder)
    update_columns_in(folder, spark.createDataFrame([(5, "five"), (6, None), (999, "no")], "k long, v string"), "k", ["v"])
    assert rows(spark, folder) == sorted([(k, n, "five" if k == 5 else v) for k, n, v in old], key=repr)
    upsert_in(folder, spark.createDataFrame([(7, 1, "a"), (7, 3, "b"), (500, 1, "c")], "k long, n long, v string"), ["k"], F.col("n"))
    got = rows(spark, folder)
    assert [r for r in got if r[0] in (7, 500)] == [(500, 1, "c"), (7, 3, "b")] and len(got) == 201 - 5 + 2


def test_nothing_to_change_and_strays(spark, folder):
    before = files(folder)
    assert replace_children_in(folder, spark.createDataFrame([], "k long, n long, v string"), "k") == []
    with pytest.raises(ValueError, match="other buckets"):
        rewrite_buckets(folder, spark.createDataFrame([(3,)], "k long"), lambda held: held.withColumn("k", F.col("k") + 1))
    assert files(folder) == before
