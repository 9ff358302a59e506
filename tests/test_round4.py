import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.functions.contents import captioned_rows
from corvane.functions.parsers import listed_rows
from corvane.operators.quotes import find_quotes
from corvane.plans.catalog import QUERIES, SQL


def one(spark, made):
    return spark.range(1).select(made.alias("r")).first().r


def test_captions_with_long_numbers(spark):
    page = "<body>Titles 1000 Words Sections 1-9 1001-B Fees Sections 10, 11 7 Acts of 1974 And later Sections 12-13 66666 Rules Section 14 Stay Connected"
    rows = one(spark, captioned_rows(F.lit(page), "Titles", "Stay Connected"))
    assert [tuple(r) for r in rows] == [("1000", "Words"), ("1001-B", "Fees"), ("66666", "Rules")]


def test_rows_numbered_with_any_letter(spark):
    page = "Sections 1146 Drivers 1147-A Rule 1147-a Rule 1148-[ More 1149-12 Range 12345 Long Stay Connected"
    assert one(spark, listed_rows(F.lit(page), "Sections", "Stay Connected")) == ["1146", "1147-A", "1147-a", "1148-["]


@pytest.mark.parametrize("keys", [[19_700, 19_799, 19_800, 19_801, 59_999], [0, 234_000, 288_000, 359_999]])
def test_contents_walk_of_many_suppliers(spark, tmp_path, keys):
    """Articles past 999; sections whose letters are past Z, or differ in case only."""
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    want = duck.execute(SQL["contents_walk"]).fetchall()
    got = QUERIES["contents_walk"](spark, str(tmp_path)).select("source", "kind", "number", "depth", "parent").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def first_places(docs, items, verbatim):
    out = []
    for item, quote in items:
        for doc, text in docs:
            at = text.find(quote)
            loose = None if verbatim or at >= 0 else re.search(r"\s+".join(map(re.escape, quote.split())), text)
            if at >= 0 or loose:
                out.append((item, doc, *((at, at + len(quote)) if at >= 0 else loose.span())))
    return sorted(out)


@pytest.mark.parametrize("verbatim", [True, False])
def test_short_passages_equal_brute_force(spark, verbatim):
    """Words inside words, blanks of all kinds, signs beyond 16 bits, passages at the borders of texts."""
    draw = random.Random(4)
    made = lambda n, parts: "".join(draw.choice(parts) for _ in range(n))
    docs = [(i, made(draw.randrange(40), ["a", "b", "ab", "é", "\U0001f600", " ", " ", "  ", "\n", "\t", "\xa0"])) for i in range(200)] + [(200, ""), (201, "a"), (202, "b a"), (203, "a" * 5000)]
    forms = ["{0}", "{0} {1}", "{0} {1}", "{0}  {1}", "{0}\n{1}", " {0}", "{0} ", "{0}\xa0{1}", "{0}\t{1} "]
    items = [(i, draw.choice(forms).format(made(draw.randrange(1, 4), ["a", "b", "é", "\U0001f600"]), made(draw.randrange(1, 4), ["a", "b", "\U0001f600"]))) for i in range(300)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, find_quotes(d, q, verbatim=verbatim).collect())) == first_places(docs, items, verbatim)


def test_passages_that_begin_alike_are_not_tried_one_by_one(spark):
    """30,000 passages of one first word, looked for in 400 texts with it: before, each was looked for in each text."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("begins 7 "), F.repeat(F.lit("all that "), 3000)).alias("text"))
    items = spark.range(30_000).select(F.col("id").alias("item_id"), F.concat(F.lit("begins "), "id").alias("text"))
    begun = time.monotonic()
    assert find_quotes(docs, items, verbatim=True).groupBy("item_id").count().collect() == [(7, 400)]
    assert time.monotonic() - begun < 20


def test_hits_of_short_passages_are_not_shuffled(spark, tmp_path):
    """What all texts hold meets its items where it was found, though the plan can't know that these are few."""
    spark.createDataFrame([(i, f"The {i} and") for i in range(100)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["short_quotes"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
