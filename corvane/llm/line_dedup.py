"""Repeated lines and passages, found by winnowing.

A document is the sequence of the hashes of its words; each word knows whether it begins a line. Two kinds of windows are
fingerprinted. A line window is the shortest stretch of whole lines, from a given line on, with at least `window_words`
words; its fingerprint is the hash of the stretch. For passages that begin or end inside lines, the hashes of GRAM words
in a row are winnowed: of each `passage_words - GRAM + 1` consecutive ones the smallest is a fingerprint, so that every
passage of `passage_words` words that occurs twice has a fingerprint in common, at the same place in it, and one in some
seventeen words has to be kept. Lines that are passages by themselves have no line window.

Each fingerprint is joined with its earliest place (by id, then word), never with all others in pairs: the join stays
linear in hot fingerprints. A match is extended both ways, word by word. Of what is equal, a passage of `passage_words` or
more is deleted in the later place, and of anything shorter its whole lines, if they are lines in the earlier place too
and have `window_words` words together. Matches take with them slices of the earlier document around them, at most SPAN
words and twice REACH, and meet the later text where it is edited; a run that goes on has its next fingerprint within REACH.

What that leaves out: a passage whose fingerprints all have an earlier place that shares GRAM or more words with it but
less than `passage_words`, while a later place shares it whole.

The earliest occurrence of a word window always stays. A document whose whole text equals an earlier one loses all of it.
"""

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corvane.llm.common import free_name, settle, without

WINDOW_WORDS = 10
PASSAGE_WORDS = 48
#: Words in a row that are hashed together.
GRAM = 16
#: Words by which a match's slice goes on at both ends, and places that share a slice.
REACH, SPAN = 64, 1024
#: Up to so many documents that others repeat, their ids are broadcast to the scan that reads them again.
MOST_NEEDED = 1_000_000
#: Characters of the texts whose words are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20

_FACTOR, _LINE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _words_of_lines(text: str) -> list[list[bytes]]:
    """The words (between ASCII white space) of each line."""
    return [line.split() for line in text.encode("utf-8", "surrogatepass").split(b"\n")]


_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _xxh64(letters: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The XXH64 (seed 0) of each [first, last), all at once; words of 32 bytes and more by themselves."""
    eight = np.ndarray((len(letters) + 1,), "<u8", letters + bytes(8), strides=(1,))  # from each byte on
    at, left = first.copy(), last - first
    out = left.astype(np.uint64) + _P5
    for least, mask in ((8, None), (8, None), (8, None), (4, 0xFFFFFFFF), (1, 0xFF), (1, 0xFF), (1, 0xFF)):
        some = np.flatnonzero(left >= least)
        lane, x = eight[at[some]], out[some]
        if least == 8:
            x = _turned(x ^ _turned(lane * _P2, 31) * _P1, 27) * _P1 + _P4
        elif least == 4:
            x = _turned(x ^ (lane & np.uint64(mask)) * _P1, 23) * _P2 + _P3
        else:
            x = _turned(x ^ (lane & np.uint64(mask)) * _P5, 11) * _P1
        out[some] = x
        at[some] += least
        left[some] -= least
    for by, factor in ((33, _P2), (29, _P3)):
        out = (out ^ out >> np.uint64(by)) * factor
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(last - first >= 32).tolist():
        out[i] = xxh64_intdigest(letters[first[i] : last[i]])
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of the texts, one text after the other; the numbers of the words that begin lines; the number of
    the first word of each text, and of all words behind the last one."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw)
    letters = np.frombuffer(joined, np.uint8)
    blank = np.concatenate([[True], (letters == 32) | (letters - np.uint8(9) < 5), [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = edges[::2], edges[1::2]
    line = np.searchsorted(np.flatnonzero(letters == 10), first)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    return _xxh64(joined, first, last), np.flatnonzero(np.diff(line, prepend=-1)), np.r_[0, np.searchsorted(first, ends)]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Places (first, end) of texts that are hashed at once."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(text)
    if texts:
        yield first, len(texts)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _window_hashes(hashes: np.ndarray, first: np.ndarray | slice, last: np.ndarray | slice) -> np.ndarray:
    """Polynomials in the hashes of [first, last), the same wherever a window lies."""
    n = len(hashes) + 1
    if len(_powers[0]) < n:
        factors = _FACTOR, np.uint64(pow(int(_FACTOR), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * n, f)]) for f in factors]
    up, down = _powers
    sums = np.zeros(n, np.uint64)
    np.add.accumulate(hashes * up[: n - 1], out=sums[1:])
    return (sums[last] - sums[first]) * down[first]


def line_windows(hashes: np.ndarray, starts: np.ndarray, bounds: np.ndarray, least: int, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, fingerprint) of each line window, but of lines of `passage` or more words. Words that begin lines are marked.
    Texts begin at `bounds`, each with a line."""
    edges = np.append(starts, len(hashes))
    ends = np.minimum(np.searchsorted(edges, starts + least), len(starts))
    within = (edges[ends] >= starts + least) & (edges[ends] <= bounds[np.searchsorted(bounds, starts, "right")])
    some = np.flatnonzero(within & (np.diff(edges) < passage))
    if not len(some):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    marked = hashes.copy()
    marked[starts] ^= _LINE
    return starts[some], _window_hashes(marked, edges[some], edges[ends[some]]) ^ _LINE


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """`of` (minimum or maximum) each `width` consecutive values."""
    span = 1
    while 2 * span <= width:
        values, span = of(values[:-span], values[span:]), 2 * span
    return of(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def winnowed(hashes: np.ndarray, passage: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(word, fingerprint): the smallest hash of GRAM words among each passage - GRAM + 1 consecutive ones; all of them if
    several are the smallest. Of several texts, which begin at `bounds`, each is winnowed by itself."""
    width = passage - GRAM + 1
    if len(hashes) < passage:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    n = len(hashes) - GRAM + 1
    grams = _window_hashes(hashes, slice(0, n), slice(GRAM, GRAM + n))
    least = _sliding(grams, width, np.minimum)  # of the windows that begin at each place
    if bounds is not None:  # windows that go on into the next text count for nothing
        inner = bounds[1:-1]
        m = len(least) + 1
        over = np.bincount(np.clip(inner - passage + 1, 0, m - 1), minlength=m) - np.bincount(np.minimum(inner, m - 1), minlength=m)
        least[np.cumsum(over)[:-1] > 0] = 0
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(padded, width, np.maximum) == grams)
    return at, grams[at]


def marked_words(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words as 31 bits of their hashes and, in the lowest bit, whether they begin a line."""
    words = (hashes >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)
    words[starts] |= np.uint32(1)
    return words.view(np.int32)


def fingerprints(texts: list[str], window_words: int = WINDOW_WORDS, passage_words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, fingerprints, cuts) of texts, one after the other; those of text i lie from cuts[i] to cuts[i + 1]."""
    hashes, starts, bounds = word_hashes(texts)
    found = line_windows(hashes, starts, bounds, window_words, passage_words), winnowed(hashes, passage_words, bounds)
    at, keys = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], bounds)
    return (at[order] - np.repeat(bounds[:-1], np.diff(cuts))).astype(np.int32), keys[order].view(np.int64), cuts


def _words_of(texts: list[str]) -> list[np.ndarray]:
    """marked_words of each text."""
    out: list[np.ndarray] = []
    for first, end in _chunks(texts):
        hashes, starts, bounds = word_hashes(texts[first:end])
        out += np.split(marked_words(hashes, starts), bounds[1:-1])
    return out


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many first values are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        same = a[at : min(at + step, n)] == b[at : min(at + step, n)]
        if not same.all():
            return at + int(same.argmin())
        at, step = at + len(same), 2 * step
    return n


def _begins(words: np.ndarray, lo: int, hi: int, end: bool) -> np.ndarray:
    """Whether a line begins at each word from lo to hi; `end` for the place behind the last word."""
    part = words[lo : hi + 1] & 1 > 0
    return part if hi < len(words) else np.append(part, end)


def _whole_lines(own: np.ndarray, other: np.ndarray, lo: int, hi: int, shift: int, own_end: bool, other_end: bool) -> list[tuple[int, int]]:
    """Stretches of [lo, hi) that are whole lines, the same ones on both sides. The ends of the slices are line ends where
    the documents end there."""
    mine, theirs = _begins(own, lo, hi, own_end), _begins(other, lo - shift, hi - shift, other_end)
    either = np.flatnonzero(mine | theirs)
    both = (mine & theirs)[either]
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(both[:-1] & both[1:]):
        first, last = lo + int(either[i]), lo + int(either[i + 1])
        if out and out[-1][1] == first:
            out[-1] = out[-1][0], last
        else:
            out.append((first, last))
    return out


def repeats(own: np.ndarray, other: np.ndarray, at: np.ndarray, from_: np.ndarray, ends: tuple[bool, bool], least: int, passage: int) -> list[tuple[int, int, int]]:
    """Runs (first, end, shift) of `own` to delete, for matches of place `at` with place `from_` of `other`: shift is what
    lies between a word and its earlier copy. Matches inside a run that has been found are not extended again."""
    a, b, out = own | 1, other | 1, []
    order = np.lexsort((from_, at))
    done = -1
    for i, j in zip(at[order].tolist(), from_[order].tolist()):
        if i + GRAM <= done:
            continue
        hi = i + _equal_ahead(a[i:], b[j:])
        lo = i - _equal_ahead(a[:i][::-1], b[:j][::-1])
        if hi - lo >= passage:
            out.append((lo, hi, i - j))
            done = max(done, hi)
        elif hi - lo >= least:
            out += [(x, y, i - j) for x, y in _whole_lines(own, other, lo, hi, i - j, *ends) if y - x >= least]
    return sorted(set(out))


def earlier_slices(docs: DataFrame, id_col: str, text_col: str, window_words: int, passage_words: int) -> DataFrame:
    """(id, th, m): for each distinct (id, text) with fingerprints of earlier texts, the text's hash and its matches: their
    places, and the slices of the earlier documents around them. A match without places is with an equal text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def lists(cuts: np.ndarray, values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, end in _chunks(texts):
                at, keys, cuts = fingerprints(texts[first:end], window_words, passage_words)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), lists(cuts, at), lists(cuts, keys)], ["id", "th", "places", "keys"])

    def words_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, end in _chunks(texts):
                hashes, starts, bounds = word_hashes(texts[first:end])
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), lists(bounds, marked_words(hashes, starts))], ["id", "th", "words"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = settle(texts.mapInArrow(hashed, f"id {kind}, th long, places array<int>, keys array<long>"), "fingerprints")
    marks = found.select("id", "th", F.explode(F.arrays_zip("places", "keys")).alias("m")).select("id", "th", F.col("m.places").alias("at"), F.col("m.keys").alias("key"))

    place = F.struct("id", "th", "at")
    earliest = marks.groupBy("key").agg(F.min(place).alias("e"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "e")
    earliest = settle(earliest, "earliest")  # a plain scan, so that the join can split a hot fingerprint; so below
    later = marks.join(earliest, "key").where(place != F.col("e")).select("id", "th", "at", F.col("e.id").alias("from_id"), F.col("e.th").alias("from_th"), F.col("e.at").alias("from_at"))
    later = settle(later, "matches")
    whole = F.col("th").eqNullSafe(F.col("from_th")) & ~F.col("id").eqNullSafe(F.col("from_id"))

    spans = [F.floor(F.col(c) / SPAN).alias(f"_{c}") for c in ("at", "from_at")]  # at most SPAN places in a row of what follows
    parts = later.where(~whole).groupBy("id", "th", "from_id", "from_th", *spans).agg(F.collect_list(F.struct("at", "from_at")).alias("m"))
    parts = settle(parts.select("id", "th", "from_id", "from_th", F.col("m.at").alias("at"), F.col("m.from_at").alias("from_at")), "parts")
    needed = settle(parts.select("from_id", "from_th").distinct(), "needed")
    near = F.broadcast(needed) if needed.limit(MOST_NEEDED + 1).count() <= MOST_NEEDED else needed
    read = texts.join(near, texts["th"].eqNullSafe(near["from_th"]) & texts["id"].eqNullSafe(near["from_id"]), "left_semi")
    words = settle(read.mapInArrow(words_only, f"id {kind}, th long, words array<int>").dropDuplicates(["id", "th"]), "needed-words")

    low, high = F.greatest(F.array_min("from_at") - REACH, F.lit(0)), F.array_max("from_at") + GRAM + REACH
    joined = parts.alias("p").join(words.alias("w"), F.col("p.from_th").eqNullSafe(F.col("w.th")) & F.col("p.from_id").eqNullSafe(F.col("w.id"))).select("p.*", "w.words")
    row = lambda at, from_at, from_id, first, n, other: F.struct(at.alias("at"), from_at.alias("from_at"), from_id.alias("from_id"), first.cast("int").alias("first"), n.cast("int").alias("n"), other.alias("other"))
    slices = joined.select("id", "th", row(F.col("at"), F.col("from_at"), F.col("from_id"), low, F.size("words"), F.slice("words", low + 1, high - low)).alias("m"))
    none = F.array().cast("array<int>")
    copies = later.where(whole).groupBy("id", "th").agg(F.min("from_id").alias("from_id")).select("id", "th", row(none, none, F.col("from_id"), F.lit(0), F.lit(0), none).alias("m"))
    return slices.unionByName(copies).groupBy("id", "th").agg(F.collect_list("m").alias("m"))


_SPACE = " \t\n\r\x0b\x0c"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+")


def _kept_words(line: str, gone: np.ndarray) -> str:
    """The line without the marked words. What stands between two kept words stays."""
    kept = "".join(compress(_PIECE.findall(line), (~gone).tolist())) + line[len(line.rstrip(_SPACE)) :]
    return kept.lstrip(_SPACE) if gone[0] else kept


Run = tuple[int, int, object, int]


def runs_of(own: np.ndarray, matches: zip, least: int, passage: int) -> list[Run]:
    """Runs (first, last, from_id, from_first) of a text's words to delete, for matches (at, from_at, from_id, first, n,
    other) as in earlier_slices."""
    out: set[Run] = set()
    for at, from_at, from_id, first, n, other in matches:
        if not len(at):
            out.add((0, len(own) - 1, from_id, 0))
            continue
        found = repeats(own, np.asarray(other), np.asarray(at), np.asarray(from_at) - first, (True, first + len(other) == n), least, passage)
        out |= {(lo, hi - 1, from_id, first + lo - shift) for lo, hi, shift in found}
    return sorted(out, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3]))


def _edited(text: str, own: np.ndarray, runs: list[Run]) -> tuple:
    """(text without the runs, lines that went whole, words that went, runs)"""
    lines, sizes = text.split("\n"), list(map(len, _words_of_lines(text)))
    change, at, removed, kept = np.zeros(len(own) + 1, np.int64), 0, [], []
    for first, last, _, _ in runs:
        change[first] += 1
        change[last + 1] -= 1
    gone = np.cumsum(change)[:-1] > 0
    for i, (line, n) in enumerate(zip(lines, sizes)):
        here = gone[at : at + n]
        at += n
        if n and here.all():
            removed.append(i)
        else:
            kept.append(_kept_words(line, here) if here.any() else line)
    return "\n".join(kept), removed, int(gone.sum()), runs


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_words: int = WINDOW_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """`docs` with the later repeats of lines and passages deleted from the texts, and columns n_lines (of the old text),
    removed_lines (numbers of the lines that went whole, from 0), removed_words and runs (see runs_of; null if there are
    none); these replace columns of the same names.

    Lines and passages are equal when their words are, whatever white space is between them. Every run of whole lines with
    `window_words` or more words that occurred earlier, in a document with a smaller id or higher up in the same one, is
    deleted, and so is every passage of `passage_words` words (10 to REACH) wherever in a line it begins. A blank line is
    no part of a run and stays. Every row stays, even if all its lines go. Null texts stay null; empty texts stay. Rows
    with equal id and text are one document: they get equal results and aren't repeats of one another. A null id sorts
    before all others. Texts may be of any length. Other columns are kept as they are. An empty table gives an empty result.
    """
    if not max(GRAM, window_words) <= passage_words <= REACH:
        raise ValueError(f"passages have {GRAM} to {REACH} words, and at least those of a window")
    kind = docs.schema[id_col].dataType.simpleString()
    kept = without(docs.columns, "n_lines", "removed_lines", "removed_words", "runs")
    own = free_name(docs, "_th")
    names = ["text", "removed", "n_words", "runs"]

    def edit(texts: pd.Series, *matches: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = [(None, None, None, None)] * len(texts)
        some = np.flatnonzero(texts.notna()).tolist()
        held, columns = [texts.iat[i] for i in some], [m.tolist() for m in matches]
        for i, text, words in zip(some, held, _words_of(held)):
            runs = runs_of(words, zip(*(c[i] for c in columns)), window_words, passage_words)
            if runs:
                rows[i] = _edited(text, words, runs)
        return pd.DataFrame(rows, columns=names)

    matched = earlier_slices(docs, id_col, text_col, window_words, passage_words)
    left = docs.withColumn(own, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    joined = left.alias("_d").join(matched.alias("_r"), F.col(f"_d.{own}").eqNullSafe(F.col("_r.th")) & F.col(f"_d.{id_col}").eqNullSafe(F.col("_r.id")), "left")
    schema = f"text string, removed array<long>, n_words long, runs array<struct<first:long,last:long,from_id:{kind},from_first:long>>"
    edited = F.pandas_udf(edit, schema).asNondeterministic()  # run once, though it is read five times

    def column(name: str) -> Column:
        return F.when(F.col("_e.runs").isNotNull(), F.col("_e.text")).otherwise(F.col(f"_k.{name}")).alias(name) if name == text_col else F.col(f"_k.{name}").alias(name)

    text, kept_as_is = F.col(f"_k.{text_col}"), F.array().cast("array<long>")
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    # texts without a match don't leave the JVM
    done = edited(F.when(F.col("_r.m").isNotNull(), F.col(f"_d.{text_col}")), *(F.col(f"_r.m.{c}") for c in ("at", "from_at", "from_id", "first", "n", "other"))).alias("_e")
    edited = joined.select(F.struct(*(F.col(f"_d.{c}").alias(c) for c in dict.fromkeys([*kept, text_col])), F.lit(0).alias(free_name(docs, "_none"))).alias("_k"), done)
    return edited.select(
        *map(column, kept), n_lines.alias("n_lines"), F.coalesce("_e.removed", kept_as_is).alias("removed_lines"), F.coalesce("_e.n_words", F.lit(0)).cast("long").alias("removed_words"), F.col("_e.runs").alias("runs")
    )
