"""Text of PDF files. The reader of a file's bytes is given by the caller, as no PDF library is part of the engine; what
follows it is relational: pages, series, ranges of pages, and the text of each instruction."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: bytes of a file -> texts of its pages
PageReader = Callable[[bytes], list[str]]
#: Pages with less text are taken for scans.
SCANNED_CHARS = 50


def pdf_pages(files: DataFrame, read: PageReader) -> DataFrame:
    """(path, page, text, scanned) of binary files, pages from 1; a file that can't be read gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    pages = read(bytes(content)) if bytes(content[:5]) == b"%PDF-" else None
                    rows += [(path, i, t, len(t) < SCANNED_CHARS, None) for i, t in enumerate(pages, 1)] if pages is not None else [(path, None, None, None, "not a PDF")]
                except Exception as problem:  # noqa: BLE001  one broken file must not end the job; its row says why
                    rows.append((path, None, None, None, str(problem)))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "scanned", "error"]).astype({"page": "Int32", "scanned": "boolean"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, scanned boolean, error string")


def whole_text(pages: DataFrame, marker: str = "[Page %d]") -> DataFrame:
    """(path, text): the pages that have text, in order, each under its marker."""
    some = pages.where("page is not null AND trim(text) <> ''")
    parts = F.array_sort(F.collect_list(F.struct("page", F.concat(F.format_string(marker, "page"), F.lit("\n"), "text").alias("t"))))
    return some.groupBy("path").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("text"))


def instruction_pages(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Instructions with their series and text. `outline` has (path, at, page, title, is_series) in outline order `at`; an
    instruction ends where the next entry on a later page begins, and belongs to the last series at or before it."""
    order = Window.partitionBy("path").orderBy("at")
    entries = outline.withColumn("series", F.last(F.when(F.col("is_series"), F.col("title")), ignorenulls=True).over(order))
    later = Window.partitionBy("path").orderBy("page").rangeBetween(1, Window.unboundedFollowing)
    entries = entries.withColumn("end", F.min("page").over(later)).where(~F.col("is_series"))
    last = pages.groupBy("path").agg((F.max("page") + 1).alias("past"))
    spans = entries.join(last, "path").withColumn("end", F.coalesce("end", "past"))
    listed = spans.withColumn("page_no", F.explode(F.sequence("page", F.greatest(F.col("end") - 1, F.col("page")))))
    joined = listed.join(pages.select("path", F.col("page").alias("page_no"), "text"), ["path", "page_no"])
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return joined.groupBy("path", "at", "title", "series", "page", "end").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
