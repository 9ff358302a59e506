"""Near copies by five-word SimHash fingerprints through pivot distance tables, and by blocks of equal minima for what lies
further apart; links are verified exactly, by the Jaccard similarity of five-word shingles.

Texts with equal sets of shingles are one node. First, fingerprints go through the operator of `llm/simhash.py`: segment
blocks and pivot distances give all that are at most PIVOT_RADIUS bits apart. A similarity of 0.8 leaves fingerprints some
ten bits apart, though: at such a radius, distances to pivots discard hardly a pair, and no choice of segments is left on
which a pair must agree. So further candidates come from blocks of equal minima: BANDS times BAND_ROWS minima of seeded
hashes, a block for each band. A pair at 0.8 shares a block with probability 1 - (1 - 0.8^4)^14 = 0.9994. Of the pairs that
are looked at, those whose fingerprints differ in more than RADIUS bits drop out, and the others are verified on the shingles
themselves.

Pairs within a group of copies are not listed. Each node is first compared with one head: the smallest node of its blocks.
What that links is one component, and from then on only nodes of different components are compared: first with the heads of
all their blocks, then with each other in the few blocks that still hold several components. Such a block of more than
`block_rows` nodes is dealt out again by each other band; one that is larger even then is compared in tasks of two parts of
PART_ROWS nodes each, which give the edges of a spanning forest.
"""

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corvane.llm.common import free_name, settle
from corvane.llm.graph import connected_components
from corvane.llm.simhash import AT_ONCE, pivot_links

SHINGLE_WORDS = 5
BANDS, BAND_ROWS = 14, 4
#: Bits up to which the pivot tables' segment blocks hold all pairs.
PIVOT_RADIUS = 3
#: Bits; at a similarity of 0.8 fingerprints differ in 9.7 on average, with a standard deviation of 2.9.
RADIUS = 22
BLOCK_ROWS = 32
#: Nodes whose shingles a task holds, for each of its two parts.
PART_ROWS = 128

_rng = np.random.default_rng(11)
_XOR, _MUL = _rng.integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64)
_MUL |= np.uint64(1)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's word windows, ascending; of all its words if they are fewer; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    n = max(len(found) - words + 1, 1)
    windows = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else iter([b" ".join(found)])
    return np.unique(np.fromiter(map(xxh64_intdigest, windows, repeat(42)), np.uint64, n))


def sketch(hashes: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(node, SimHash fingerprint, key of each band) of a set of shingles."""
    ones, least = np.zeros(64, np.int64), np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    for start in range(0, len(hashes), AT_ONCE // 16):
        part = hashes[start : start + AT_ONCE // 16]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, ((part[None, :] ^ _XOR) * _MUL).min(axis=1))
    raw, width = least.tobytes(), 8 * BAND_ROWS
    keys = np.fromiter((xxh64_intdigest(raw[i : i + width]) for i in range(0, len(raw), width)), np.uint64, BANDS)
    fp = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0]
    return int(np.uint64(xxh64_intdigest(hashes.tobytes())).view(np.int64)), int(fp), keys.view(np.int64)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [sketch(shingles(t)) for t in batch["text"]]
        yield pd.DataFrame({"id": batch["id"], "node": [f[0] for f in found], "fp": [f[1] for f in found], "keys": [f[2] for f in found]})


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (similarity of 0.8 or more) among sets of shingles."""
    sizes = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(code, np.cumsum(sizes)[:-1])
    edges, rest, marked = [], np.arange(len(sets)), np.zeros(len(code), np.int64)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            marked[parts[at]] = 1
            both = np.fromiter((marked[parts[i]].sum() for i in rest), np.int64, len(rest))
            marked[parts[at]] = 0
            near = 9 * both >= 4 * (sizes[rest] + sizes[at])
            edges += [(at, other) for other in rest[near]]
            queue += list(rest[near])
            rest = rest[~near]
    return edges


def _block_forest(block: pd.DataFrame) -> pd.DataFrame:
    nodes = block["node"].to_numpy()
    edges = np.array(forest([np.asarray(s) for s in block["shingles"]]), np.int64).reshape(-1, 2)
    return pd.DataFrame({"u": nodes[edges[:, 0]], "v": nodes[edges[:, 1]]})


def _near(fp: str, other: str) -> Column:
    return F.bit_count(F.col(fp).bitwiseXOR(F.col(other))) <= RADIUS


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) with a similarity of 0.8 or more."""
    left, right = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(left, "u").join(right, "v").where(9 * both >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def _pivot_pairs(reps: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes whose fingerprints are at most PIVOT_RADIUS bits apart, enough of them to connect all: each with
    the smallest node of its fingerprint, and these along the links of the pivot tables."""
    least = settle(reps.groupBy("fp").agg(F.min("node").alias("v")), "fingerprint-nodes")
    same = reps.select("node", "fp").join(least, "fp").where("node <> v").select(F.col("node").alias("u"), "v")
    near = pivot_links(least.select("fp"), PIVOT_RADIUS).distinct()
    named = near.join(least.select(F.col("fp").alias("u"), F.col("v").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("v").alias("b")), "v")
    return settle(same.unionByName(named.select(F.col("a").alias("u"), F.col("b").alias("v"))), "pivot-pairs")


def _open_blocks(rows: DataFrame, keys: list[str], links: DataFrame) -> DataFrame:
    """The rows of the blocks that hold several components, with their component."""
    labels = connected_components(links)
    named = settle(rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "named-blocks")
    mixed = named.groupBy(*keys).agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count(F.lit(1)).alias("n")).where("_a <> _b").select(*keys, "n")
    return settle(named.join(settle(mixed, "mixed-blocks"), keys), "open-blocks")


def _across(rows: DataFrame, keys: list[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Near pairs (u, v) of different components in blocks of up to `block_rows` rows, and the rows of larger blocks."""
    small = rows.where(F.col("n") <= block_rows)
    other = small.select(*keys, F.col("node").alias("v"), F.col("fp").alias("other"), F.col("component").alias("its"))
    pairs = small.join(other, keys).where((F.col("node") < F.col("v")) & (F.col("component") != F.col("its")) & _near("fp", "other"))
    return pairs.select(F.col("node").alias("u"), "v"), rows.where(F.col("n") > block_rows)


def _large_blocks(rows: DataFrame, keys: list[str], sets: DataFrame) -> DataFrame:
    """Edges of spanning forests of large blocks, by tasks that each hold two parts of one."""
    parts = F.ceil(F.col("n") / PART_ROWS)
    part = F.pmod(F.xxhash64("node"), parts)
    dealt = rows.select("node", *keys, parts.alias("parts"), part.alias("part"))
    mates = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda m: F.struct(F.least("part", m).alias("x"), F.greatest("part", m).alias("y")))
    tasks = dealt.select("node", *keys, F.explode(mates).alias("m")).select("node", *keys, "m.x", "m.y")
    return tasks.join(sets, "node").groupBy(*keys, "x", "y").applyInPandas(_block_forest, "u long, v long")


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, bands: int = BANDS) -> DataFrame:
    """One row per row of `docs`: the id and component_id, the smallest id reachable over links.

    Linked are rows whose texts have a Jaccard similarity of 0.8 or more on their sets of five-word shingles (words
    between ASCII white space, ASCII letters in lower case), whole texts of any length. Texts without a word, null ones
    too, are equal to each other. A text of fewer words has one shingle, of all its words. Repeated rows get equal
    results. Null ids get a component_id where another row of the component has an id. Other columns are ignored. An
    empty table gives an empty result. Without `bands`, links are those of PIVOT_RADIUS bits only.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = settle(texts.mapInPandas(_sketches, f"id {kind}, node long, fp long, keys array<long>"), "sketches")
    reps = settle(rows.groupBy("node").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), F.min("keys").alias("keys")), "representatives")

    by_pivots = _pivot_pairs(reps)
    dealt = settle(reps.select("node", "fp", F.posexplode(F.slice("keys", 1, bands)).alias("t", "key")), "dealt")
    heads = dealt.groupBy("t", "key").agg(F.min(F.struct("node", "fp")).alias("h"), F.max("node").alias("last")).where("h.node <> last")
    heads = settle(heads.select("t", "key", F.col("h.node").alias("head"), F.col("h.fp").alias("head_fp")), "heads")  # a plain scan, so that the join can split a hot block
    blocks = settle(dealt.join(heads, ["t", "key"]), "blocks")

    both_sides = by_pivots.select(F.explode(F.array("u", "v")).alias("node"))
    needed = settle(blocks.select("node").unionByName(both_sides).distinct(), "needed")
    own = settle(rows.join(needed, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")), "sources")

    @F.pandas_udf("array<long>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).view(np.int64) for t in texts])

    @F.pandas_udf("long")
    def node_of(hashes: pd.Series) -> pd.Series:
        return pd.Series([np.uint64(xxh64_intdigest(np.asarray(h, np.int64).tobytes())).view(np.int64) for h in hashes], dtype="int64")

    # an id that repeats with other texts gives sets of other nodes, which the joins below leave out
    held = texts.join(own.select("id").distinct(), texts["id"].eqNullSafe(own["id"]), "left_semi").select(hashed("text").alias("shingles"))
    sets = settle(settle(held.withColumn("node", node_of("shingles")), "hashed").dropDuplicates(["node"]), "sets")

    near = blocks.where((F.col("node") != F.col("head")) & _near("fp", "head_fp"))
    first = settle(near.groupBy("node").agg(F.min("head").alias("v")).select(F.col("node").alias("u"), "v"), "first-heads")
    first = first.join(by_pivots, ["u", "v"], "left_anti")  # those are verified once
    links = settle(_verified(by_pivots.unionByName(first), sets), "links")
    open_ = _open_blocks(blocks, ["t", "key"], links)
    if open_.limit(1).count():
        of_head = open_.where("node = head").select("t", "key", F.col("component").alias("its"))
        more = open_.join(settle(of_head, "head-components"), ["t", "key"]).where((F.col("component") != F.col("its")) & _near("fp", "head_fp")).select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
        links = settle(links.unionByName(_verified(settle(more, "more-heads"), sets)), "links")
        open_ = _open_blocks(open_.drop("component", "n"), ["t", "key"], links)
        pairs, large = _across(open_, ["t", "key"], block_rows)
        finer = ["t", "key", "t2", "key2"]
        again = large.drop("component", "n").join(reps.select("node", "keys"), "node").select("node", "fp", "t", "key", F.posexplode("keys").alias("t2", "key2")).where("t <> t2")
        again = _open_blocks(settle(again, "dealt-again"), finer, links)
        finer_pairs, hot = _across(again, finer, block_rows)
        pairs = settle(pairs.unionByName(finer_pairs).distinct(), "pairs")
        links = links.unionByName(_verified(pairs, sets)).unionByName(_large_blocks(hot, finer, sets))
    labels = connected_components(links)

    labelled = settle(reps.join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root")), "labelled")
    heads = settle(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    found = settle(labelled.join(heads, "root").select("node", "component_id"), "node-components")
    return rows.join(found, "node").select(F.col("id").alias(id_col), "component_id")


def one_of_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose id is the smallest of their group; rows that repeat that id are one document. Nulls, empty
    and long texts as in near_copy_groups; rows with a null id stay if their whole group has none. All columns are kept."""
    kept = near_copy_groups(docs, id_col, text_col, **options).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    name = free_name(docs, "_kept")
    return docs.join(kept.select(F.col(id_col).alias(name)).distinct(), F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
