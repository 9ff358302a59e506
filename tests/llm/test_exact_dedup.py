import hashlib
import re

from corvane.llm.exact_dedup import exact_dedup

LONG = "x" * 300


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), t in zip(rows, norm):
        ids = [j for (j, _), u in zip(rows, norm) if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (1, "a  b"), (2, "a b"), (3, "a\tb"), (4, None), (5, ""), (6, "a c"), (7, LONG + "1"), (8, LONG + "2"), (9, LONG + "1"), (9, LONG + "1"), (None, "a b"), (None, "z"),
    (10, " "), (11, "é" * 20000), (12, "é" * 20000), (13, "b a"),
]


def test_matches_brute_force(docs_of):
    got = exact_dedup(docs_of(ROWS), digest_all=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ROWS)


def test_hashes_only_survivors_and_ignores_other_columns(docs_of, spark):
    got = exact_dedup(docs_of(ROWS).withColumnsRenamed({"lang": "keep_id", "source": "_h"}), sieve_buckets=1 << 20)
    found = {r.doc_id: r for r in got.collect()}
    assert found[6].text_sha256 is None or found[6].group_size == 1
    assert found[13].kept and found[1].keep_id == 1 and not found[2].kept and found[2].text_sha256


def test_one_sieve_bucket_changes_nothing(docs_of):
    got = exact_dedup(docs_of(ROWS), sieve_buckets=1, digest_all=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ROWS)


def test_empty_table(docs_of):
    assert exact_dedup(docs_of([])).count() == 0
