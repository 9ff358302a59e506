"""Overlapping chunks that end at paragraphs or sentences where they can."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 500, 100


def chunk_spans(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each chunk. A chunk ends behind the last paragraph break past its half, else behind the last
    sentence end past its half, else at `size`; the next one starts `overlap` earlier. ValueError unless the overlap is
    under half the size, as chunks might not advance otherwise."""
    if overlap >= size // 2:
        raise ValueError("overlap must be less than half the size")
    spans, start = [], 0
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            half = start + size // 2
            stops = [text.rfind("\n\n", start, end)]
            if stops[0] <= half:
                stops = [text.rfind(mark, start, end) for mark in (". ", "! ", "? ")]
            if max(stops) > half:
                end = max(stops) + 2
        spans.append((start, end))
        if end >= len(text):
            return spans
        start = end - overlap


def chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array of (chunk_idx, text, char_start, char_end); texts are stripped, offsets aren't. Chunks of white space only
    are left out, but an empty text is one empty chunk; null gives null."""

    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            found = [(t[a:b].strip() if len(t) > size else t, a, b) for a, b in chunk_spans(t, size, overlap)]
            found = [f for f in found if f[0] or len(t) <= size]
            out.append([{"chunk_idx": i, "text": x, "char_start": a, "char_end": b} for i, (x, a, b) in enumerate(found)])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(cut, "array<struct<chunk_idx:int,text:string,char_start:int,char_end:int>>")(text)


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row per chunk. No shuffle: chunks stay where their document is."""
    return docs.select(F.col(id_col), F.inline(chunks(F.col(text_col), size, overlap)))
