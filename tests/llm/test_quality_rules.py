import re
from collections import Counter

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.quality_rules import _best_condition, fit_rules, keep_good, learn_rules, quality_report, text_counts


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet="ab \n\t#é", max_size=80), st.text(max_size=40)))
def test_counts_match_brute_force(text):
    assert text_counts(text)[:5] == plain_counts(text)


def test_counts_of_long_texts_with_many_words():
    rng = np.random.default_rng(1)
    text = " ".join(f"w{i}" for i in rng.integers(0, 20_000, 30_000)) + " a b c d e" * 3
    assert text_counts(text)[:5] == plain_counts(text)
    assert text_counts(None)[:5] == (0, 0, 0, 0, 0)


def test_learns_a_conjunction_and_nothing_from_noise():
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"a": rng.random(4000), "b": rng.random(4000)})
    bad = ((frame.a > 0.7) & (frame.b <= 0.4)).to_numpy()
    rules = learn_rules(frame, bad)
    assert rules and all(r.precision >= 0.95 for r in rules)
    covered = np.zeros(4000, bool)
    for r in rules:
        hit = np.ones(4000, bool)
        for n, above, cut in r.conditions:
            hit &= (frame[n] > cut) if above else (frame[n] <= cut)
        covered |= hit
    assert (covered & bad).sum() > 0.9 * bad.sum()
    assert learn_rules(frame, rng.random(4000) < 0.2) == []


def test_verdicts_and_odd_rows(spark, docs_of):
    good = [(i, " ".join(f"word{i}x{j}" for j in range(30))) for i in range(150)]
    junk = [(200 + i, " ".join(f"w{i}y{j}###" for j in range(30))) for i in range(150)]
    odd = [(500, None), (501, ""), (502, "a b c d e " * 30), (None, good[0][1]), (1, good[1][1])]
    docs = docs_of(good + junk + odd).withColumnsRenamed({"lang": "kept", "source": "n_words"})
    labels = spark.createDataFrame([(i, 1 if i < 200 else 0, 0) for i, _ in good[::2] + junk[::2]] + [(3, None, 0), (None, 1, 0), (7777, 0, 0)], "doc_id long, quality int, toxic int")
    rules = fit_rules(docs, labels)
    got = quality_report(docs, rules).toPandas()
    assert len(got) == 305 and rules
    kept = got[got["kept"]]["doc_id"].dropna().astype(int).tolist()
    assert sorted(kept) == sorted([i for i, _ in good] + [1])
    assert got[got["base_failed"]]["doc_id"].tolist() == [500, 501, 502] or set(got[got["base_failed"]]["doc_id"]) == {500, 501, 502}
    assert sorted(r.doc_id for r in keep_good(docs, rules).collect() if r.doc_id is not None) == sorted(kept)
    assert fit_rules(docs, labels.limit(0)) == [] and quality_report(docs_of([]), rules).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.booleans()), min_size=2, max_size=25))
def test_the_best_condition_is_the_one_of_an_exhaustive_search(rows):
    x = {"a": np.array([r[0] for r in rows], float), "b": np.array([r[1] for r in rows], float)}
    bad = np.array([r[2] for r in rows])
    if bad.all() or not bad.any():
        return
    gain = lambda hit: (bad & hit).sum() * (np.log2((bad & hit).sum() / hit.sum()) - np.log2(bad.mean())) if (bad & hit).any() else 0.0
    cover = lambda name, above, cut: x[name] > cut if above else x[name] <= cut
    every = [gain(cover(n, above, cut)) for n in x for above in (True, False) for cut in np.unique(x[n])[:-1]]
    found = _best_condition(x, bad, np.ones(len(bad), bool), 256)
    assert gain(cover(*found)) == max(every) if found else max(every, default=0) <= 1e-9


def test_clashing_columns_stay(docs_of):
    docs = docs_of([(1, " ".join(f"w{i}" for i in range(20))), (2, None)]).withColumnsRenamed({"lang": "_counts", "source": "n_words"})
    got = keep_good(docs, [])
    assert got.columns == docs.columns and [(r.doc_id, r._counts) for r in got.collect()] == [(1, "en")]
