import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from corvane.llm.graph import connected_components
from corvane.llm.simhash import fingerprint, one_of_each_group, pivot_links, simhash_groups


def plain_fingerprint(text):
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(items, radius):
    """Smallest id reachable, over all pairs."""
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(items):
        for j, (_, b) in enumerate(items[:i]):
            if bin(a ^ b).count("1") <= radius:
                parent[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(items):
        groups.setdefault(root(i), []).append(key)
    return {key: min(groups[root(i)]) for i, (key, _) in enumerate(items)}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "Ärger ÄRGER a b c", "a b c d e f g " * 50, "nbsp word next one"])
def test_fingerprint_bits(text):
    assert fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_long_text_is_hashed_whole(monkeypatch):
    import corvane.llm.simhash as m

    text = " ".join(str(random.Random(1).randrange(99)) for _ in range(1000))
    whole = fingerprint(text)
    monkeypatch.setattr(m, "AT_ONCE", 7)
    assert fingerprint(text) == whole


def test_groups_match_brute_force(docs_of):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(80)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        for k in range(4):
            words = t.split()
            for _ in range(k):
                words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
            rows.append((100 + 10 * i + k, " ".join(words).upper() if k == 1 else " ".join(words)))
    rows += [(900, None), (901, ""), (902, "short"), (903, "SHORT"), (3, base[3])]
    docs = docs_of(rows).withColumnsRenamed({"lang": "fp", "source": "component_id"})
    got = simhash_groups(docs).collect()
    want = components([(i, plain_fingerprint(t)) for i, t in rows], 3)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{plain_fingerprint(t):016x}" for i, t in rows}
    assert sorted(r.doc_id for r in one_of_each_group(docs_of(rows)).collect()) == sorted(i for i, _ in rows if want[i] == i)


@pytest.mark.parametrize("block_rows", [2, 40, 4096])
def test_dense_balls_are_split_without_losing_links(spark, block_rows):
    rng = random.Random(9)
    centers = [rng.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centers for _ in range(150)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = pivot_links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(5), block_rows=block_rows)
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(bin((r.u ^ r.v) & (1 << 64) - 1).count("1") <= 3 for r in edges.collect())
    want = components([(f, f & (1 << 64) - 1) for f in signed], 3)
    assert {f: found.get(f, f) for f in signed} == want


def test_components_of_a_long_path_and_loops(spark):
    path = list(range(60))
    random.Random(2).shuffle(path)
    rows = [(a, b) for a, b in zip(path, path[1:])] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100, 101: 100}


def test_empty_table(docs_of):
    assert simhash_groups(docs_of([])).count() == 0


def test_pivot_filter_loses_no_link():
    from corvane.llm.simhash import distance_table, pivots

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 500, np.uint64)
    b = a ^ np.uint64(0b1011)
    assert (np.abs(distance_table(a, pivots()) - distance_table(b, pivots())) <= 3).all()
