import random

import pytest

import corpus_pipeline
from corvane.llm.near_copies import near_copy_groups, shingles, sketch
from corvane.llm.simhash import fingerprint


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def components(rows):
    """Smallest id reachable over all pairs at a similarity of 0.8 or more."""
    sets, parent = [(i, plain_shingles(t)) for i, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(sets):
        groups.setdefault(root(i), []).append(key)
    return {key: min(groups[root(i)]) for i, (key, _) in enumerate(sets)}


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
    return " ".join(words)


@pytest.mark.parametrize("block_rows", [2, 32])
def test_groups_match_brute_force(docs_of, block_rows):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(150)) for _ in range(15)]
    rows = list(enumerate(base)) + [(100 + 10 * i + k, edited(rng, t, k)) for i, t in enumerate(base) for k in range(6)]
    rows += [(900, None), (901, ""), (902, "short"), (903, "SHORT")]
    got = {r.doc_id: r.component_id for r in near_copy_groups(docs_of(rows), block_rows=block_rows).collect()}
    assert got == components(rows)


def test_the_stage_drops_copies_beyond_three_bits(spark, docs_of):
    rng = random.Random(8)
    rows = []
    for i in range(30):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(150))
        rows += [(2 * i, text), (2 * i + 1, edited(rng, text, 2))]
    far = [i for i in range(0, 60, 2) if bin((fingerprint(rows[i][1]) ^ fingerprint(rows[i + 1][1])) & (1 << 64) - 1).count("1") > 3]
    assert far and all(v % 2 == 0 for v in components(rows).values())
    kept = corpus_pipeline.near_duplicates(spark, docs_of(rows), "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 60, 2))


def bits_apart(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def test_pivot_tables_give_all_links_within_three_bits(docs_of):
    rng = random.Random(21)
    rows = []
    for i in range(25):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(400))
        rows += [(10 * i + k, edited(rng, text, k) if k else text) for k in range(4)]
    rows += [(900, None), (901, " "), (902, "short one"), (903, "Short  one")]
    fps = {i: sketch(shingles(t))[1] for i, t in rows}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in rows:
        for j, b in rows:
            x, y = plain_shingles(a), plain_shingles(b)
            if bits_apart(fps[i], fps[j]) <= 3 and 5 * len(x & y) >= 4 * len(x | y):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {i: root(i) for i, _ in rows}
    assert 10 < sum(i != r for i, r in want.items()) < 75  # some near copies are further apart, which the bands find
    assert {r.doc_id: r.component_id for r in near_copy_groups(docs_of(rows), bands=0).collect()} == want
    assert {r.doc_id: r.component_id for r in near_copy_groups(docs_of(rows)).collect()} == components(rows)
