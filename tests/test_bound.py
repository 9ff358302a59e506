import pytest
from pyspark.sql import functions as F

from corvane.functions import contents, parsers
from corvane.functions.arrays import bound, first_of_each
from corvane.functions.contents import SOURCES


def plan(spark, made):
    rows = spark.createDataFrame([("x",)], "t string")
    return rows.select(made(F.col("t")).alias("r"))._jdf.queryExecution().analyzed().toString()


def test_bound_reads_a_value_once(spark):
    text = plan(spark, lambda t: bound(F.upper(t), lambda x: F.concat(x, x, x)))
    assert text.count("upper(") == 1
    assert spark.createDataFrame([("a",), (None,)], "t string").select(bound(F.upper("t"), lambda x: F.concat(x, x))).collect() == [("AA",), (None,)]


@pytest.mark.parametrize("source", ["tx_public_law", "ca_leginfo_pages"])
def test_a_link_is_taken_apart_once(spark, source):
    text = plan(spark, lambda t: contents.toc_sections(t, SOURCES[source]))
    assert text.count("regexp_extract(") == 1 and text.count("lower(") <= 2


@pytest.mark.parametrize("source", ["co_public_law", "nv_public_law", "or_public_law"])
def test_a_page_is_split_once_for_all_its_links(spark, source):
    own = F.struct(F.lit("article").alias("kind"), F.lit("").alias("number"), F.lit("article_1").alias("key"))
    assert plan(spark, lambda t: contents.contents_links(t, own, SOURCES[source])).count("(?i)<a(?=") == 1


def test_page_facts_read_the_label_once(spark):
    assert plan(spark, parsers.page_facts).count("meta-name-and-number") == 1
    assert plan(spark, parsers.breadcrumbs).count("from_json(") == 1
    assert plan(spark, parsers.subsections).count("(?s)(<p") == 1 and plan(spark, parsers.heading).count("regexp_replace(") == 1


def test_first_of_each(spark):
    items = [("b", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5), ("a", 6), (None, 7)]
    rows = spark.createDataFrame([(items,), ([],), (None,)], "x array<struct<k:string,v:int>>")
    got = [r[0] if r[0] is None else [tuple(x) for x in r[0]] for r in rows.select(first_of_each(F.col("x"), "k")).collect()]
    assert got == [[("b", 1), ("a", 2), ("c", 5)], [], None]
