import random

import numpy as np
import pytest

from xxhash import xxh64_intdigest

from corvane.llm.line_dedup import GRAM, drop_repeated_lines, fingerprints, winnowed, word_hashes


def brute(rows, least):
    """For every window, the earliest equal window; the match extended line by line; the union of what is later."""
    docs = {}
    for key, text in rows:
        docs.setdefault((key, text or ""), [x.strip() for x in (text or "").split("\n") if x.strip()])
    order = sorted(docs, key=lambda k: (k[0] is not None, k[0] or 0))
    grams, gone = {}, {k: set() for k in docs}
    for k in order:
        lines = docs[k]
        for i in range(len(lines)):
            j, n = i, 0
            while j < len(lines) and n < least:
                n += len(lines[j].split())
                j += 1
            if n >= least:
                gram = tuple(lines[i:j])
                if gram not in grams:
                    grams[gram] = k, i
                    continue
                other, at = grams[gram]
                a, b, shift = lines, docs[other], i - at
                lo = i
                while lo > 0 and lo - 1 - shift >= 0 and a[lo - 1] == b[lo - 1 - shift]:
                    lo -= 1
                hi = i
                while hi < len(a) and hi - shift < len(b) and a[hi] == b[hi - shift]:
                    hi += 1
                gone[k] |= set(range(lo, hi))
    out = []
    for key, text in rows:
        if text is None:
            out.append((key, None))
            continue
        n, kept = -1, []
        for line in text.split("\n"):
            n += bool(line.strip())
            if not (line.strip() and n in gone[(key, text)]):
                kept.append(line)
        out.append((key, "\n".join(kept)))
    return sorted(out, key=repr)


def made(seed, docs=60):
    rng = random.Random(seed)
    pool = [" ".join(f"p{i}w{j}" for j in range(rng.randrange(1, 9))) for i in range(12)]
    rows = []
    for i in range(docs):
        lines = []
        for _ in range(rng.randrange(0, 8)):
            if rng.random() < 0.5:
                start = rng.randrange(len(pool) - 3)
                lines += pool[start : start + rng.randrange(1, 4)]
            else:
                lines.append(f"own {i} {rng.random()}")
            if rng.random() < 0.2:
                lines.append("  ")
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(docs_of, seed):
    rows = [*made(seed), (900, None), (901, ""), (902, "\n\n"), (3, "a b c\na b c\na b c\na b c\na b c"), (903, "one two three four five six seven eight nine ten"), (904, "x\n one two three four five six seven eight nine ten \ny")]
    rows = [r for i, r in enumerate(rows) if r[0] not in [x[0] for x in rows[:i]]]
    got = drop_repeated_lines(docs_of(rows).withColumnsRenamed({"lang": "runs_", "source": "th"}), window_words=6, passage_words=64)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == brute(rows, 6)


def test_repeated_rows_are_one_document_and_columns_stay(docs_of):
    rows = [(1, "alpha beta gamma delta\nown"), (1, "alpha beta gamma delta\nown"), (2, "alpha beta gamma delta\nother")]
    got = drop_repeated_lines(docs_of(rows), window_words=4)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, rows[0][1]), (1, rows[0][1]), (2, "other")]
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_own_columns_replace_those_of_the_same_name(docs_of):
    docs = docs_of([(1, "a b c d"), (2, "a b c d\nx")]).withColumnsRenamed({"lang": "runs", "source": "N_Lines", "n_chars": "_th"})
    got = drop_repeated_lines(docs, window_words=4)
    assert got.columns == ["doc_id", "text", "_th", "n_lines", "removed_lines", "removed_words", "runs"]
    assert sorted((r.doc_id, r.text, r._th, r.n_lines, r.removed_lines, r.removed_words) for r in got.collect()) == [(1, "a b c d", 7, 1, [], 0), (2, "x", 9, 2, [0], 4)]


def test_run_spans_are_reported(docs_of):
    rows = [(5, "a a a a\nb b b b\nc"), (9, "z\na a a a\nb b b b\nc\nq")]
    runs = {r.doc_id: r.runs for r in drop_repeated_lines(docs_of(rows), window_words=8).collect()}
    assert runs[5] is None and [tuple(x) for x in runs[9]] == [(1, 9, 5, 0)]


def test_empty_table(docs_of):
    assert drop_repeated_lines(docs_of([])).count() == 0


def test_whole_copies_of_any_length_go(docs_of):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long), (3, "before " + long + " behind"), (None, "short text"), (4, "short text")]
    got = {r.doc_id: (r.text, r.removed_words) for r in drop_repeated_lines(docs_of(rows)).collect()}
    assert got == {1: (long, 0), 2: ("", 60_000), 3: ("before behind", 60_000), None: ("short text", 0), 4: ("short text", 0)}


def test_equal_lines_take_linear_time(spark, docs_of):
    import time

    line = "the same line of twelve words comes again and again in here"
    began = time.time()
    got = drop_repeated_lines(docs_of([(1, "\n".join([line] * 100_000)), (2, "own")]))
    assert {r.doc_id: r.text for r in got.collect()} == {1: line, 2: "own"}
    assert time.time() - began < 120


def passages(seed):
    """Texts with passages of 40 to 70 words inside their lines, at any place."""
    rng = random.Random(seed)
    pool = [[f"p{i}x{j}" for j in range(rng.randrange(40, 71))] for i in range(6)]
    rows = []
    for i in range(40):
        words = [f"o{i}y{j}" for j in range(rng.randrange(30))]
        for k in range(rng.randrange(3)):
            words += rng.choice(pool) + [f"o{i}z{k}q{j}" for j in range(rng.randrange(30))]
        rows.append((i, "".join(w + (rng.choice("\n  ") if rng.random() < 0.1 else " ") for w in words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_repeated_passage_goes_and_nothing_else(docs_of, seed):
    rows = passages(seed)
    seen, want = set(), {}
    for key, text in rows:
        words = text.split()
        grams = [tuple(words[i : i + 40]) for i in range(len(words) - 39)]
        gone = set()
        for i, g in enumerate(grams):
            if g in seen or g in grams[:i]:
                gone |= set(range(i, i + 40))
        seen |= set(grams)
        want[key] = [w for i, w in enumerate(words) if i not in gone]
    got = drop_repeated_lines(docs_of(rows), window_words=40, passage_words=40)
    assert {r.doc_id: r.text.split() for r in got.collect()} == want


def test_every_passage_has_its_minimum_selected():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    at, keys = winnowed(h, 40)
    assert len(at) < 80 and all(any(s <= p <= s + 40 - GRAM for p in at) for s in range(400 - 39))
    again, same = winnowed(h[100:160], 40)
    assert set(same) & set(keys) and len(winnowed(h[:39], 40)[0]) == 0
    assert len(winnowed(np.full(300, 5, np.uint64), 40)[0]) == 300 - GRAM + 1


def test_texts_hashed_together_have_the_fingerprints_that_each_has_alone():
    rng = random.Random(12)
    texts = ["", " ", "\n\n", "a\nb c\n\n d ", "q\n" * 60, "\x0bx \x85y\xa0z\n"]
    for _ in range(60):
        lines = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([0, 1, 3, 12, 70]))) for _ in range(rng.randrange(9))]
        texts.insert(rng.randrange(len(texts)), "\n".join(lines))
    at, keys, cuts = fingerprints(texts, 10, 48)
    assert len(at) > 300
    for i, text in enumerate(texts):
        alone = fingerprints([text], 10, 48)
        assert [x.tolist() for x in alone[:2]] == [at[cuts[i] : cuts[i + 1]].tolist(), keys[cuts[i] : cuts[i + 1]].tolist()]
        words = text.encode().split()
        assert all(0 <= p < len(words) for p in alone[0])
        windows = {(p, k) for p, k in zip(*winnowed(np.array([xxh64_intdigest(w) for w in words], np.uint64), 48))}
        assert {(p, k) for p, k in windows} <= {(int(p), k) for p, k in zip(alone[0], alone[1].view(np.uint64))}


def test_words_are_hashed_by_xxh64_whatever_their_length():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé\u4e2dxyz\ud800") for _ in range(n % 45 + 1)) for n in range(500)]
    hashes, starts, bounds = word_hashes(["\n".join(words), "", words[0]])
    assert hashes.tolist() == [xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in [*words, words[0]]]
    assert starts.tolist() == list(range(501)) and bounds.tolist() == [0, 500, 500, 501]
