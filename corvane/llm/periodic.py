"""Runs: maximal stretches of words that repeat with a period, found by Lyndon words.

Every run contains, for the order of the alphabet or for its reverse, a Lyndon word as long as its period, and this word
reaches from its first word to the next smaller suffix. So one pass for each order, in the manner of Ellert and Fischer,
finds all candidates: suffixes that have no smaller one behind them yet wait in a stack; each new suffix is compared with
those on top, and takes away those that it is smaller than. A comparison begins where the comparison before it left off,
as the length matched between neighbours in the stack is kept; and what was once matched at a distance is remembered with
its end, so that no two words are compared twice at one distance. Words are compared with each other only: no suffix
array, no hashes of stretches. Candidates whose match, extended to both sides, is shorter than their period are dropped.

A word that occurs once in its text is in no run; a text is cut at such words first.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import free_name, without

LEAST_WORDS = 12


def _ahead(w: list[int], a: int, b: int) -> int:
    """How many words from a on equal those from b > a on."""
    n, at, step = len(w) - b, 0, 8
    while at < n:
        if w[a + at : min(a + at + step, a + n)] != w[b + at : b + at + step]:
            while w[a + at] == w[b + at]:
                at += 1
            return at
        at, step = at + step, 2 * step
    return n


def _behind(w: list[int], a: int, b: int, least: int) -> int:
    """How many words before a, from `least` on, equal those before b > a."""
    n, at, step = a - least, 0, 8
    while at < n:
        k = min(step, n - at)
        if w[a - at - k : a - at] != w[b - at - k : b - at]:
            while w[a - at - 1] == w[b - at - 1]:
                at += 1
            return at
        at, step = at + k, 2 * step
    return n


def _roots(w: list[int], found: list[tuple[int, int, int]]) -> None:
    """Add (period, start, match) of each Lyndon word that reaches from a suffix to the next smaller one and that the words
    around it don't already rule out: `match` words of it are repeated behind it."""
    n = len(w)
    top, matched = [0], [0]  # suffixes without a smaller one so far; words each has in common with the one below it
    ends: dict[int, tuple[int, int]] = {}  # distance: first and last word known to match at this distance
    for i in range(1, n):
        x, s = w[i], i - 1
        y = w[s]
        if y < x:
            top.append(i)
            matched.append(0)
            continue
        common, keep = 0, 0
        fresh = y == x
        while True:
            if fresh:  # the words up to `common` are equal: find out how many more are
                d, at = i - s, s + common
                known = ends.get(d)
                if known and known[0] <= at <= known[1]:
                    common = known[1] - s
                else:
                    common += _ahead(w, at, at + d)
                    ends[d] = s, s + common
                if i + common < n and w[s + common] < w[i + common]:
                    keep = common
                    break
            top.pop()
            below = matched.pop()
            if common or w[s - 1] == w[i - 1]:
                found.append((i - s, s, common))
            if not top:
                break
            s = top[-1]
            if common < below:  # the suffix below begins like the one just taken away
                fresh = False
            elif common > below:
                keep = below
                break
            elif common:
                fresh = True
            else:
                y = w[s]
                if y < x:
                    break
                fresh = y == x
        top.append(i)
        matched.append(keep)
    for s in top:
        if s and w[s - 1] == w[n - 1]:
            found.append((n - s, s, 0))


def runs_of(w: list[int], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` words, by start, then period. Words are numbers of 0 or more."""
    found: list[tuple[int, int, int]] = []
    _roots(w, found)
    _roots([-x for x in w], found)
    found.sort()
    out, period, end = [], 0, -1
    for p, s, match in found:
        if p != period:
            period, end = p, -1
        if s <= end:  # the same stretch again
            continue
        begin = s - _behind(w, s, s + p, end + 1)
        end = s + match
        if end - begin >= p and end - begin + p >= least:
            out.append((begin, end - begin + p, p))
    out.sort(key=lambda r: (r[0], r[2]))
    return out


def text_runs(text: str, least: int = LEAST_WORDS) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """The words of a text (between ASCII white space) and its runs."""
    words = text.encode("utf-8", "surrogatepass").split()
    if len(words) < least:
        return words, []
    number: dict[bytes, int] = {}
    w = [number.setdefault(x, len(number)) for x in words]
    numbers = np.array(w)
    cuts = np.r_[-1, np.flatnonzero(np.bincount(numbers)[numbers] == 1), len(w)]
    out = []
    for i in np.flatnonzero(np.diff(cuts) > least):
        first = int(cuts[i]) + 1
        out += [(first + s, length, p) for s, length, p in runs_of(w[first : int(cuts[i + 1])], least)]
    return words, out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words, each run cut down to its first period, joined by one space."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    if runs:
        words = [words[i] for i in np.flatnonzero(change[:-1].cumsum() == 0)]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """The rows with n_words long, runs array<struct<start, length, period: long>> and collapsed string added; columns of
    these names are replaced.

    Words lie between ASCII white space. A run is a stretch of words with smallest period p, at least `least` and 2p
    words long, that no neighbouring word extends; runs come by start, then period. Null and empty texts have no words
    and no runs and collapse to an empty text. Rows are worked on one by one, whole, without a shuffle, so repeated
    rows and null ids make no difference; an empty table gives an empty result. Time grows as words times the logarithm of their
    number at worst. A text needs some 200 bytes of memory a word.
    """
    made = ("n_words", "runs", "collapsed")
    columns = without(docs.columns, *made)
    text = free_name(docs, "t")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    schema += ", n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def add(batches: Iterator) -> Iterator:


        for batch in batches:
            rows = [text_runs(t.as_py(), least) for t in batch.column(text)]
            spans = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for _, runs in rows]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            added = [pa.array([len(w) for w, _ in rows], pa.int64()), pa.array(spans, kind), pa.array([collapsed(w, r) for w, r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *added], names=[*columns, *made])

    return docs.select(*columns, F.coalesce(text_col, F.lit("")).alias(text)).mapInArrow(add, schema)
