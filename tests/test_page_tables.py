import random

import pytest

from corvane.operators.page_tables import page_tables

SCHEMA = "page long, word string, x0 double, x1 double, top double, bottom double"


def boxes(page, tables, jitter=0.0, seed=0):
    """Words of tables laid out in columns as wide as their widest cell."""
    rng, out, y = random.Random(seed), [], 20.0
    shift = lambda: rng.uniform(-jitter, jitter)
    for rows in tables:
        widths = [max(6 * len(r[c]) for r in rows) for c in range(len(rows[0]))]
        for row in rows:
            x = 30.0
            for c, cell in enumerate(row):
                at = x
                for word in cell.split():
                    dy = shift()
                    out.append((page, word, at + shift(), at + 6 * len(word) - 2 + shift(), y + dy, y + 9 + dy))
                    at += 6 * len(word) + 3
                x += widths[c] + 20
            y += 14
        y += 50
    rng.shuffle(out)
    return out


def found(spark, words, **options):
    got = page_tables(spark.createDataFrame(words, SCHEMA).repartition(3), ["page"], **options).orderBy("page", "table", "row").collect()
    out = {}
    for r in got:
        assert r.row == len(out.setdefault((r.page, r.table), []))
        out[r.page, r.table].append(list(r.cells))
    return out


A = [["Section", "Rule name", "Fine"], ["21453", "Red light signal", "100"], ["22350", "Speed", ""], ["", "Basic rule again", "35 or more"]]
B = [["1", "2"], ["three four", "5"]]


@pytest.mark.parametrize("jitter", [0.0, 1.2])
def test_cells_come_back(spark, jitter):
    words = boxes(1, [A, B], jitter) + boxes(2, [B], jitter, 3)
    assert found(spark, words, column_gap=8.0) == {(1, 0): A, (1, 1): B, (2, 0): B}


def test_odd_words(spark):
    words = [(1, "a", 10.0, 2.0, 20.0, 12.0), (1, " ", 0.0, 900.0, 0.0, 900.0), (1, None, 0.0, 1.0, 0.0, 1.0), (1, "b", None, 1.0, 0.0, 1.0), (1, "c", 30.0, 36.0, 13.0, 20.0), (1, "c", 30.0, 36.0, 13.0, 20.0)]
    assert found(spark, words) == {(1, 0): [["a", "c c"]]}
    assert found(spark, words[:0]) == {}


def test_gaps_are_parameters(spark):
    words = [(1, "a", 0.0, 10.0, 0.0, 10.0), (1, "b", 14.0, 20.0, 0.0, 10.0), (1, "c", 0.0, 10.0, 12.0, 20.0)]
    assert found(spark, words) == {(1, 0): [["a b"], ["c"]]}
    assert found(spark, words, column_gap=3.0) == {(1, 0): [["a", "b"], ["c", ""]]}
    assert found(spark, words, row_gap=5.0) == {(1, 0): [["a c b"]]}
    assert found(spark, words, table_gap=1.0) == {(1, 0): [["a b"]], (1, 1): [["c"]]}


def test_a_page_s_words_are_shuffled_once_and_sorted_in_no_window(spark):
    words = spark.createDataFrame(boxes(1, [A, B]) + boxes(2, [B], 0.5, 3), SCHEMA)
    plan = page_tables(words, ["page"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_words_of_one_place_go_by_their_letters_and_pages_may_hold_none(spark):
    same = [(1, w, 0.0, 10.0, 0.0, 10.0) for w in ("b", "\u00e9", "a", "B")] + [(1, "z", 0.0, 10.0, 12.0, 20.0), (1, "x", float("nan"), 1.0, 0.0, 1.0), (2, " ", 0.0, 1.0, 0.0, 1.0)]
    assert found(spark, same) == {(1, 0): [["B a b \u00e9"], ["z"]]}
