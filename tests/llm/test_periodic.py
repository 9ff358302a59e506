import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.periodic import find_runs, runs_of
from corvane.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least):
    """Runs by trying every period at every place."""
    out = []
    for p in range(1, len(w) // 2 + 1):
        k = 0
        while k + p < len(w):
            e = k
            while e + p < len(w) and w[e] == w[e + p]:
                e += 1
            n = e - k + p
            if e - k >= p and n >= least and not any(w[k : k + n - q] == w[k + q : k + n] for q in range(1, p)):
                out.append((k, n, p))
            k = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(0, 12), st.integers(0, 6), st.sampled_from([2, 12]))
def test_runs_equal_brute_force(w, begin, times, least):
    w = w + w[begin : begin + 7] * times + w[:5]
    assert runs_of(w, least) == (brute(w, least) if w else [])


def test_every_short_text_of_two_words():
    for n in range(1, 13):
        for bits in range(1 << n):
            w = [bits >> i & 1 for i in range(n)]
            assert runs_of(w, 2) == brute(w, 2), w


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b


@pytest.mark.parametrize("w", [[0] * 700, [0, 1] * 350, fibonacci(600), [*range(20)] * 30, [0] * 200 + [1] + [0] * 200])
def test_highly_periodic_texts(w):
    assert runs_of(w, 12) == brute(w, 12)


def test_a_long_periodic_text_takes_linear_time():
    assert runs_of([0, 1, 2] * 200_000) == [(0, 600_000, 3)]
    assert len(runs_of(fibonacci(100_000))) > 10_000


def words_of(text):
    return WORD.findall(text or "")


def expected(w):
    number = {}
    runs = brute([number.setdefault(x, len(number)) for x in w], 12)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return runs, " ".join(x for i, x in enumerate(w) if i not in gone)


ROWS = [
    (1, "a b c " * 9 + "x y z"),
    (2, "one two three four five six seven eight nine ten eleven twelve " * 2),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "a\x0bb\x0ca\rb\ta\nb a b a b a b  a b"),
    (7, "a b a b" + "　a"),
    (None, "x " * 30),
    (8, "x " * 30),
    (8, "x " * 30),
    (9, "w " * 11),
    (10, "p q r s " * 4 + "é " * 15 + "p q r s " * 4),
    (11, "long text of words " * 3000),
]


def test_rows(docs_of):
    docs = docs_of(ROWS).withColumnsRenamed({"lang": "RUNS", "source": "t"})
    got = find_runs(docs)
    assert got.columns == ["doc_id", "text", "t", "n_chars", "n_words", "runs", "collapsed"]
    want = []
    for key, text in ROWS[:-1]:
        w = words_of(text)
        want.append((key, len(w), *expected(w)))
    rows = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()]
    assert sorted((r for r in rows if r[0] != 11), key=repr) == sorted(want, key=repr)
    assert [r[1:] for r in rows if r[0] == 11] == [(12_000, [(0, 12_000, 4)], "long text of words")]


def test_empty_table(docs_of):
    assert find_runs(docs_of([])).count() == 0


def planted(key, w):
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i if i < a else a + (i - a) % p] for i in range(n)]


def test_query(spark, docs_of, tmp_path):
    rows = [(i, None if i % 17 == 0 else "" if i % 19 == 0 else " ".join(f"w{i * j * j % 97}" for j in range(i % 70))) for i in range(300)] + [(900, "a b " * 20)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want, changed = {}, 0
    for key, text in rows:
        w = planted(key, words_of(text))
        changed += w != words_of(text)
        runs, kept = expected(w)
        s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want[key] = (len(runs), s, n, p, n and 1000 * n // p, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(kept))
    got = {r[0]: tuple(r)[1:8] for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert got == want and changed > 15
