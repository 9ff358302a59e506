"""SimHash near-duplicates through pivot distance tables.

Fingerprints: a document's words, in windows of three, each window hashed to 64 bits; a bit of the fingerprint is the
majority of that bit over all windows. Two fingerprints are linked at `radius` or fewer differing bits.

Links: equal fingerprints are one representative. A representative goes to one block for each choice of `radius` of
2 x radius bit segments: two fingerprints at most `radius` bits apart agree on such a choice somewhere, so no pair is
lost, and a block holds what agrees on half of the bits. The distances of each representative to a fixed set of reference
fingerprints (pivots) are computed once and travel with it. By the triangle inequality a pair whose distance to any pivot
differs by more than the radius is no link; only the survivors of that test are compared bit by bit.

Blocks are counted before they are sent anywhere. One larger than `block_rows` is dealt out again by the bits on which its
members may still differ, in the same manner; three quarters of the bits are then fixed, so the new blocks hold at most 2^16
fingerprints for any input. A block gives the edges of a spanning forest of its links, never all of its pairs.
"""

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corvane.llm.common import free_name, settle
from corvane.llm.graph import connected_components

SHINGLE_WORDS = 3
RADIUS = 3
N_PIVOTS = 16
BLOCK_ROWS = 4096
#: Groups up to this size are compared position against position, many groups at once.
SMALL = 32
#: Windows hashed at a time, so that a very long text needs no more memory than its own words.
AT_ONCE = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit SimHash of a text; 0 if it is null or has no word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(len(found) - words + 1, 1)
    if not found:
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, n, AT_ONCE):
        part = found[start : start + AT_ONCE + words - 1]
        windows = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(found) >= words else iter([b" ".join(found)])
        hashes = np.fromiter(map(xxh64_intdigest, windows, repeat(42)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) of every row."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("fp"))


def pivots(count: int = N_PIVOTS, seed: int = 7) -> np.ndarray:
    """Reference fingerprints: fixed random 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 1 << 64, count, np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def _choices(free: int, radius: int) -> list[int]:
    """Masks of `radius` out of 2 x radius nearly equal segments of the bits that are set in `free`."""
    bits = [b for b in range(64) if free >> b & 1]
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(bits, 2 * radius)]
    return [sum(c) for c in combinations(parts, radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the fingerprints of one block."""
    edges, rest = [], np.arange(len(fps))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.flatnonzero((np.abs(table[rest] - table[at]) <= radius).all(axis=1))
            near = near[np.bitwise_count(fps[rest[near]] ^ fps[at]) <= radius]
            edges += [(at, other) for other in rest[near]]
            queue += list(rest[near])
            rest = np.delete(rest, near)
    return edges


def _block_links(t: np.ndarray, key: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within whole blocks, which lie one after the other."""
    starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
    sizes = np.diff(np.r_[starts, len(t)])
    out, size_of = [], np.repeat(sizes, sizes)
    rows = np.flatnonzero((size_of > 1) & (size_of <= SMALL))
    if len(rows):
        block, f, d = np.repeat(np.arange(len(sizes)), sizes)[rows], fps[rows], table[rows]
        for lag in range(1, min(int(size_of[rows].max()), len(rows))):
            same = np.flatnonzero(block[lag:] == block[:-lag])
            same = same[(np.abs(d[same + lag] - d[same]) <= radius).all(axis=1)]
            same = same[np.bitwise_count(f[same + lag] ^ f[same]) <= radius]
            out.append((f[same], f[same + lag]))
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        f = fps[start : start + size]
        edges = np.array(_forest(f, table[start : start + size], radius), np.int64).reshape(-1, 2)
        out.append((f[edges[:, 0]], f[edges[:, 1]]))
    return out


def _linker(radius: int, n_pivots: int):
    """Over rows (t, key, fp, far) sorted by block: links (u, v)."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            far = np.frombuffer(b"".join(batch["far"]), np.int8).reshape(-1, n_pivots)
            rows = (*(batch[c].to_numpy() for c in ("t", "key", "fp")), far)
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows))
            t, key = rows[0], rows[1]
            last = np.flatnonzero((t != t[-1]) | (key != key[-1])) if len(t) else []
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from pairs(*(x[:cut] for x in rows))
            held = tuple(x[cut:] for x in rows)
        if held is not None and len(held[0]):
            yield from pairs(*held)

    def pairs(t: np.ndarray, key: np.ndarray, fps: np.ndarray, table: np.ndarray) -> Iterator[pd.DataFrame]:
        for a, b in _block_links(t, key, fps.view(np.uint64), table, radius):
            yield pd.DataFrame({"u": a.view(np.int64), "v": b.view(np.int64)})

    return link


def _dealt(rows: DataFrame, masks: dict[int, int]) -> DataFrame:
    """Each row (fp, far) once for each mask, with the bits that the mask keeps."""
    blocks = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in masks.items()])
    return rows.select("fp", "far", F.explode(blocks).alias("x")).select("x.t", "x.key", "fp", "far")


def pivot_links(fps: DataFrame, radius: int = RADIUS, refs: np.ndarray | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v): fingerprints of `fps` (fp: long, distinct) at most `radius` bits apart, enough of them to connect all."""
    refs = pivots() if refs is None else refs
    every = (1 << 64) - 1
    first = _choices(every, radius)
    link = _linker(radius, len(refs))

    @F.pandas_udf("binary")
    def distances(fp: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in distance_table(fp.to_numpy(np.int64).view(np.uint64), refs)], dtype=object)

    def linked(dealt: DataFrame) -> DataFrame:
        return settle(dealt.repartition("t", "key").sortWithinPartitions("t", "key").mapInPandas(link, "u long, v long"), "links")

    table = settle(fps.select("fp", distances("fp").alias("far")), "pivot-distances")
    dealt = _dealt(table, dict(enumerate(first)))
    hot = settle(dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select("t", "key"), "hot-blocks")
    over = sorted(r.t for r in hot.select("t").distinct().collect())  # at most as many as there are masks
    links = linked(dealt.join(hot, ["t", "key"], "left_anti") if over else dealt)
    for t in over:
        finer = {s: first[t] | m for s, m in enumerate(_choices(every & ~first[t], radius))}
        rows = _dealt(table, {t: first[t]}).join(hot.where(F.col("t") == t), ["t", "key"], "left_semi")
        links = links.unionByName(linked(_dealt(rows, finer)))
    return links


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of `docs`: the id, fingerprint (16 lowercase hex digits) and component_id.

    component_id is the smallest id reachable over links, the row's own included. Null and empty texts have no word:
    fingerprint zero, linked like any other. A text with fewer words than a window has one window, of all its words.
    Repeated rows get equal results. Null ids get a component_id where another row of the component has an id. Other
    columns are ignored. An empty table gives an empty result.
    """
    rows = settle(fingerprints(docs, id_col, text_col, words), "fingerprints")
    reps = settle(rows.groupBy("fp").agg(F.min("id").alias("least")), "representatives")
    labels = connected_components(pivot_links(reps.select("fp"), radius, block_rows=block_rows))
    labelled = settle(reps.join(labels, reps["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "labelled")
    heads = settle(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")  # a plain scan, so that the joins can split a hot component
    ids = settle(labelled.join(heads, "root").select("fp", "component_id"), "fingerprint-components")
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(ids, "fp").select(F.col("id").alias(id_col), hex16, "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose id is the smallest of their SimHash group; rows that repeat that id are one document. Nulls,
    empty texts and empty tables as in simhash_groups; rows with a null id stay if their whole group has none."""
    kept = simhash_groups(docs, id_col, text_col, **options).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    name = free_name(docs, "_kept")
    return docs.join(kept.select(F.col(id_col).alias(name)).distinct(), F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
