import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm.mixing import Mix, budget_table, fill, leaf_budgets, mix_sources


@given(st.floats(0, 1000), st.lists(st.tuples(st.floats(0.1, 9), st.floats(0, 300)), min_size=1, max_size=6))
def test_fill_respects_room_and_weights(budget, kids):
    weights, room = [k[0] for k in kids], [k[1] for k in kids]
    got = fill(budget, weights, room)
    assert all(g <= r + 1e-6 for g, r in zip(got, room))
    assert sum(got) == pytest.approx(min(budget, sum(room)), abs=1e-5)
    rates = {round(g / w, 5) for g, w, r in zip(got, weights, room) if g < r - 1e-6}
    assert len(rates) <= 1 or max(rates) - min(rates) < 1e-3


def test_shortage_goes_to_siblings_before_ancestors():
    leaves = {("a", "en"): 10, ("a", "de"): 1000, ("b", "en"): 1000}
    got = leaf_budgets(leaves, Mix(("domain", "lang"), budget=400, max_epochs=1))
    assert got == {("a", "en"): 10, ("a", "de"): 190, ("b", "en"): 200}
    got = leaf_budgets(leaves, Mix(("domain", "lang"), weights={("b",): 0.0}, budget=400, max_epochs=1))
    assert got == {("a", "en"): 10, ("a", "de"): 390, ("b", "en"): 0}
    assert sum(leaf_budgets(leaves, Mix(("domain", "lang"), budget=10**6, max_epochs=2)).values()) == 4020


def brute(spark, rows, mix):
    """Each leaf put in order and cut."""
    leaves = {}
    for key, text, lang, source, _ in rows:
        leaves.setdefault((lang, source), []).append((key, len((text or "").split())))
    budgets = leaf_budgets({k: sum(n for _, n in v) for k, v in leaves.items()}, mix)
    ids = sorted({k for v in leaves.values() for k, _ in v}, key=repr)
    hashes = {}
    for e in range(mix.max_epochs + 1):
        frame = spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.xxhash64("id", F.lit(e).cast("long"), F.lit(mix.seed).cast("long")).alias("h"))
        hashes |= {(r.id, e): r.h for r in frame.collect()}
    out = []
    for leaf, docs in leaves.items():
        total, budget = sum(n for _, n in docs), budgets[leaf]
        full = min(budget // total, mix.max_epochs) if total else 0
        out += [(k, e) for e in range(full) for k, _ in docs]
        rest = budget - full * total if full < mix.max_epochs else 0
        if rest > 0:
            for h in sorted({hashes[k, full] for k, _ in docs}):
                same = [(k, n) for k, n in docs if hashes[k, full] == h]
                rest -= sum(n for _, n in same)
                if rest < 0:
                    break
                out += [(k, full) for k, _ in same]
    return sorted(out, key=repr)


@pytest.mark.parametrize("share, epochs, most", [(0.4, 1, 100), (0.9, 2, 100), (1.7, 3, 100), (0.0, 1, 100), (0.9, 2, 3), (0.3, 1, 3)])
def test_matches_brute_force(spark, docs_of, share, epochs, most, monkeypatch):
    monkeypatch.setattr("corvane.llm.mixing.MAX_LEAVES", most)
    rows = [(i, "w " * (i * 7 % 23), ["en", "de", None][i % 3 if i % 5 else 0], f"s{i % 4}", i) for i in range(300)] + [(7, "w " * 3, "en", "s3", 0)] * 3 + [(None, "w w", "en", "s1", 0), (999, None, "xx", None, 0)]
    mix = Mix(("lang", "source"), weights={("en",): 3.0, ("en", "s1"): 0.5}, share=share, max_epochs=epochs)
    got = mix_sources(docs_of(rows), mix)
    assert sorted(((r.doc_id, r.epoch) for r in got.collect()), key=repr) == brute(spark, rows, mix)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_table(docs_of):
    assert mix_sources(docs_of([]), Mix(("lang",))).count() == 0


@pytest.mark.parametrize("seed, budget", [(1, 500), (2, 20_000), (3, 10**6), (4, 0)])
def test_budgets_as_tables_equal_those_of_the_driver(spark, seed, budget):
    rng = random.Random(seed)
    leaves = {(rng.choice("ab"), rng.choice(["en", "de", None]), f"s{i}\x1f\"{i % 3}"): rng.randrange(0, 3000) for i in range(25)}
    weights = {("a",): 2.0, ("b", None): 0.0, ("a", "en"): 5.0} | {p: rng.random() * 4 for p in list(leaves)[::4]}
    mix = Mix(("x", "y", "z"), weights=weights, budget=budget, max_epochs=2)
    rows = spark.createDataFrame([(json.dumps(list(p), separators=(",", ":")), n) for p, n in leaves.items()], "leaf string, tokens long")
    table = rows.selectExpr("to_json(from_json(leaf, 'array<string>')) AS leaf", "tokens")
    got = {tuple(json.loads(r.leaf)): r.budget for r in budget_table(table, mix).collect()}
    want = leaf_budgets(leaves, mix)
    assert set(got) <= set(want) and all(abs(got.get(p, 0) - n) <= 1 for p, n in want.items())


def test_level_values_are_never_mistaken(docs_of):
    rows = [(1, "a b", "x\x1fy", "z", 1), (2, "a b", "x", "y\x1fz", 1), (3, "a b", None, "[\"", 1), (4, "a b", "(none)", "null", 1), (5, "a b", "null", None, 1)]
    got = mix_sources(docs_of(rows), Mix(("lang", "source"), share=1.0, max_epochs=1))
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3, 4, 5]


def test_own_columns_replace_those_of_the_same_name(docs_of):
    docs = docs_of([(1, "a b"), (2, None)]).withColumnsRenamed({"lang": "epoch", "source": "_leaf", "n_chars": "n_tokens"})
    got = mix_sources(docs, Mix(("_leaf",), share=1.0))
    assert got.columns == ["doc_id", "text", "_leaf", "n_tokens", "epoch"]
    assert sorted((r.doc_id, r._leaf, r.n_tokens, r.epoch) for r in got.collect()) == [(1, "src1", 2, 0), (2, "src1", 0, 0)]
