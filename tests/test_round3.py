import pytest
from pyspark.sql import functions as F

from corvane.functions import parsers, text
from corvane.operators.quotes import find_quotes
from corvane.operators.shapes import vector_literal
from corvane.plans.catalog import QUERIES


def one(spark, made):
    return spark.range(1).select(made.alias("r")).first().r


@pytest.mark.parametrize("page, want", [("<body>a &amp; b&amp</body>", "a & b&amp"), ("<p>&eacute; &notit; &copy 1&#65;</p>", "é &notit; &copy 1A")])
def test_references_without_an_end_stay(spark, page, want):
    assert one(spark, text.visible_text(F.lit(page))) == want


def test_instruction_numbers_of_any_length(spark):
    assert tuple(one(spark, parsers.instruction_title(F.lit("19999. Turning")))) == ("19999", "Turning")


def test_vector_literals_round_the_number_itself(spark):
    """1/512 and 3/512 lie between two numbers of eight decimals: the even one is written."""
    row = spark.createDataFrame([([1 / 512, 3 / 512, -0.5, None],), (None,)], "v array<float>").select(vector_literal(F.col("v")).alias("r")).collect()
    assert [r.r for r in row] == ["[0.00195312,0.00585938,-0.50000000]", None]


@pytest.mark.parametrize("most_bytes", [4 << 20, 1])
def test_verbatim_passages(spark, most_bytes):
    docs = spark.createDataFrame([(1, "see a  b and the long  passage of words"), (2, "see a b and the long passage of words")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "a b"), (6, "the long passage of"), (7, "a b")], "item_id long, text string")
    assert sorted(r[:2] for r in map(tuple, find_quotes(docs, items, most_bytes=most_bytes, verbatim=True).collect())) == [(5, 2), (6, 2), (7, 2)]
    assert find_quotes(docs, items, most_bytes=most_bytes).count() == 6


def test_short_quotes_ask_every_document(spark, tmp_path):
    """Two documents that begin alike are two passages."""
    spark.createDataFrame([(0, "one two"), (40, "one three"), (41, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["short_quotes"](spark, str(tmp_path)).collect()
    assert sorted((r.item_id, r.doc_id) for r in got) == [(0, 0), (0, 40), (40, 0), (40, 40)]
