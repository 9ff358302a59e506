"""Tables of pages, from the boxes of their words.

A provider gives the words of a page with their boxes. Where the words' shadows on an axis leave a gap, a row or a column
ends: words are put in order of their upper or left edge, and one that begins behind all that came before it, by more than a
gap's width, begins the next. A page is a row with an array of its words, so that one shuffle brings its words together and
all the rest is done on batches of whole pages; what is in memory at once is an Arrow batch, and no less than one page.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corvane.session import ship

_BOX = ("x0", "x1", "top", "bottom")


def _firsts(code: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    return np.r_[True, code[1:] != code[:-1]][: len(code)]


def _groups(by: np.ndarray, begin: np.ndarray, end: np.ndarray, gap: float) -> np.ndarray:
    """The number of each word's group along an axis, from 0 for each value of `by`."""
    order = np.lexsort((end, begin, by))
    first = _firsts(by[order])
    part, n = np.cumsum(first) - 1, len(by)
    ends, rank = np.unique(end[order], return_inverse=True)
    reached = ends[np.maximum.accumulate(part * n + rank) - part * n]
    new = np.r_[False, begin[order][1:] - reached[:-1] > gap] & ~first
    number = np.cumsum(new)
    out = np.empty(n, np.int64)
    out[order] = number - number[first][part]
    return out


def _reading_order(cell: np.ndarray, x0: np.ndarray, top: np.ndarray, word: pa.Array) -> np.ndarray:
    """Words by cell, left edge and upper edge; those of one place by their letters."""
    order = np.lexsort((top, x0, cell))
    equal = np.flatnonzero(~(_firsts(cell[order]) | _firsts(x0[order]) | _firsts(top[order])))
    if not len(equal):
        return order
    tied, rank = order[np.union1d(equal - 1, equal)], np.zeros(len(cell), np.int64)
    rank[tied] = np.unique([w.encode() for w in word.take(pa.array(tied)).to_pylist()], return_inverse=True)[1]
    return np.lexsort((rank, top, x0, cell))


def _table_rows(page: np.ndarray, word: pa.Array, box: list[np.ndarray], gaps: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
    """(page, table, row, cells) of the words of pages."""
    x0, x1, top, bottom = box
    row_gap, column_gap, table_gap = gaps
    table = _groups(page, top, bottom, table_gap)
    whole = page * (table.max() + 1) + table
    row, column = _groups(whole, top, bottom, row_gap), _groups(whole, x0, x1, column_gap)
    n_rows, n_columns = row.max() + 1, column.max() + 1
    line = whole * n_rows + row
    cell = line * n_columns + column
    order = _reading_order(cell, x0, top, word)
    starts = np.flatnonzero(_firsts(cell[order]))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)], pa.int32()), word.take(pa.array(order))), " ")
    at = order[starts]  # a word of each cell
    tables = np.flatnonzero(_firsts(whole[at]))
    widths = np.maximum.reduceat(column[at], tables) + 1
    new = _firsts(line[at])
    rows = at[new]
    cuts = np.r_[0, np.cumsum(np.repeat(widths, np.diff(np.r_[tables, len(at)]))[new])]
    place = np.full(cuts[-1], -1)
    place[cuts[np.cumsum(new) - 1] + column[at]] = np.arange(len(at))
    cells = texts.take(pa.array(place, mask=place < 0)).fill_null("")
    return page[rows], table[rows], row[rows], pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), cells)


def tables_in_pages(pages: DataFrame, page: list[str], words: str = "words", row_gap: float = 0.0, column_gap: float = 6.0, table_gap: float = 30.0) -> DataFrame:
    """As page_tables, from a row for each page: its columns `page` and an array `words` of structs (word, x0, x1, top, bottom)."""
    ship(pages.sparkSession)
    out = StructType([StructField(c, pages.schema[c].dataType, True) for c in page] + StructType.fromDDL("table int, row int, cells array<string>").fields)
    number = lambda w, a, b, f: f(w[a].cast("double"), w[b].cast("double"))

    def held(w: Column) -> Column:
        area = sum((w[c].cast("double") for c in _BOX[1:]), w["x0"].cast("double"))
        return area.isNotNull() & ~F.isnan(area) & (F.trim(w["word"]) != "")

    def turned(w: Column) -> Column:
        sides = (("x0", "x1", F.least, "x0"), ("x0", "x1", F.greatest, "x1"), ("top", "bottom", F.least, "top"), ("top", "bottom", F.greatest, "bottom"))
        return F.struct(F.trim(w["word"]).alias("word"), *(number(w, a, b, f).alias(name) for a, b, f, name in sides))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(page))
            word, *box = lists.flatten().flatten()
            if len(word):
                at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                where, table, row, cells = _table_rows(at, word, [x.to_numpy(zero_copy_only=False) for x in box], (row_gap, column_gap, table_gap))
                keys = [batch.column(i).take(pa.array(where)) for i in range(len(page))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(table, pa.int32()), pa.array(row, pa.int32()), cells], out.names)

    whole = F.transform(F.filter(F.coalesce(F.col(words), F.array()), held), turned)
    return pages.select(*page, whole.alias("_words")).mapInArrow(found, out)


def page_tables(words: DataFrame, page: list[str], row_gap: float = 0.0, column_gap: float = 6.0, table_gap: float = 30.0) -> DataFrame:
    """(page, table, row, cells) of the rows of pages' tables, from words (page, word, x0, x1, top, bottom), y growing downwards.

    Rows are parted by gaps of more than `row_gap` between all words of one and of the next, tables by more than
    `table_gap`, columns by more than `column_gap` within a whole table. `cells` has a text for each column of its table, empty
    where the row has no word there; words of a cell are in reading order. Numbers count from 0 within the page, rows within
    the table. Words that are null or blank, or whose box isn't whole, are left out; boxes given upside down are turned.
    """
    pages = words.groupBy(*page).agg(F.collect_list(F.struct("word", *_BOX)).alias("_all"))
    return tables_in_pages(pages, page, "_all", row_gap, column_gap, table_gap)
