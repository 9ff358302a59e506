import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators import text_index
from corvane.operators.search import token_filter
from corvane.operators.text_index import BITS, files_for, index_files, literal_pieces, skipping_search, trigram_bits


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Twelve files: words by file, a word in all, odd rows in the last."""
    folder, index = (str(tmp_path_factory.mktemp("text") / n) for n in ("table", "index"))
    rows = [(i, i % 12, f"Common word number{i % 12:02} in file", f"title {i}") for i in range(240)]
    odd = [(900, 11, None, None), (901, 11, "", "İSTANBUL ÉTÉ 漢字テスト"), (902, 11, "a\\b 100% sure_thing", None), (903, 11, "ab", "x")]
    for part in range(12):
        mine = [r for r in rows + odd if r[1] == part]
        spark.createDataFrame(mine, "id long, part int, text string, title string").coalesce(1).write.mode("append").parquet(folder)
    assert index_files(spark, folder, ["text", "title"], index) == 12
    return folder, index


@pytest.mark.parametrize(
    ("query", "most"),
    [
        ("NUMBER07", 1), ("common number07", 1), ("number07 number08", 0), ("common", 12), ("in", 12), ("num%r03", 2), ("n_mber03", 1), ("istanbul", 1), ("i̇stanbul", 1), ("été 漢字", 1), ("a\\b", 12),
        ("100% sure", 1), ("sure_thing", 1), ("absent-word", 0), ("title number05", 1), ("%", 12), ("ab", 12),
    ],
)
def test_same_rows_from_fewer_files(spark, stored, query, most):
    folder, index = stored
    want = spark.read.parquet(folder).where(token_filter(query, F.col("text"), F.col("title")))
    got = skipping_search(spark, folder, ["text", "title"], index, query)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    assert got.columns == want.columns and len(files_for(spark, folder, index, query)) <= most


def test_only_candidates_are_read(spark, stored):
    folder, index = stored
    got = skipping_search(spark, folder, ["text", "title"], index, "number07")
    assert len(got.inputFiles()) == 1 and len(spark.read.parquet(folder).inputFiles()) == 12


def test_new_files_are_read_until_they_are_indexed(spark, tmp_path):
    folder, index = f"{tmp_path}/t", f"{tmp_path}/i"
    write = lambda n, text: spark.createDataFrame([(n, text)], "id long, text string").coalesce(1).write.mode("append").parquet(folder)
    write(1, "first words")
    assert index_files(spark, folder, ["text"], index) == 1 and index_files(spark, folder, ["text"], index) == 0
    write(2, "second words")
    find = lambda q: sorted(r.id for r in skipping_search(spark, folder, ["text"], index, q).collect())
    assert find("second") == [2] and find("words") == [1, 2] and len(files_for(spark, folder, index, "first")) == 2
    assert index_files(spark, folder, ["text"], index) == 1
    assert find("second") == [2] and len(files_for(spark, folder, index, "first")) == 1 and find("") == []


def test_a_filter_has_a_bound():
    assert trigram_bits(b"ab").size == 0 and trigram_bits(bytes(range(256)) * 9000).max() < BITS
    assert literal_pieces("A%bc_d  %  x") == ["a", "bc", "d", "x"] and literal_pieces(None) == []


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=3, max_size=40), st.integers(0, 30), st.integers(3, 10))
def test_a_part_of_a_text_has_no_other_trigrams(text, begin, n):
    part = text[begin : begin + n]
    assert set(trigram_bits(part.encode("utf-8", "surrogatepass")).tolist()) <= set(trigram_bits(text.encode("utf-8", "surrogatepass")).tolist())


def test_long_texts_in_pieces(monkeypatch):
    data = "some words and other ones, é".encode() * 9
    whole = set(trigram_bits(data).tolist())
    monkeypatch.setattr(text_index, "_AT_ONCE", 5)
    assert set(trigram_bits(data).tolist()) == whole
