import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.alignment import align, aligner, default_vocabularies
from corvane.llm.queries import QUERIES

WORK = aligner(*default_vocabularies())
ODD = ["<|endoftext|> x", "<s>hi</s>", "naïve 漢字 🙂 ok\n\n x", "\x00a", "  two  spaces ", "\t tab", "ﬁ①", "a b", "a" * 300, " ", "1234 don't"]


def spans(side, ids):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(side.bytes[i]), int(i)))
        at = out[-1][1]
    return out


def brute(text):
    """(A tokens, B tokens, groups, links) with all pairs of tokens looked at; the tokenisers are called by themselves."""
    if not text:
        return None
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabularies()[0])
    library.encode_special_tokens = True
    a = spans(WORK.a, library.encode(f" {text}", add_special_tokens=False).ids)
    b = spans(WORK.b, WORK.b.model.encode(text))
    data = f" {text}".encode()
    if b"".join(WORK.a.bytes[i] for *_, i in a) != data or b"".join(WORK.b.bytes[i] for *_, i in b) != data:
        return None
    groups, low = [], 0
    for cut in sorted({e for _, e, _ in a} & {e for _, e, _ in b}):
        inside = [",".join(str(i) for s, e, i in side if low <= s and e <= cut) for side in (a, b)]
        groups.append("|".join(inside))
        low = cut
    links = [(i, j) for s, e, i in a for t, f, j in b if s < f and t < e]
    return len(a), len(b), groups, links


def one(text):
    ids = WORK.tokens(text)
    if ids is None:
        return None
    a, b = ids
    cut_a, cut_b, link_a, link_b = WORK.align(a, b)
    assert len(cut_a) == len(cut_b)
    return len(a), len(b), WORK.groups_text(a, b, cut_a, cut_b).split(";"), sorted(zip(a[link_a].tolist(), b[link_b].tolist()))


def same(text):
    want = brute(text)
    got = one(text)
    assert (got is None) == (want is None)
    if want:
        assert got == (*want[:3], sorted(want[3]))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


def test_space_sign_in_a_text_has_no_tokens():
    assert one("▁x y") is None and one("") is None


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(text):
    same(text)


def expected(rows):
    found = [(key, brute(text)) for key, text in rows]
    counts = Counter(link for _, f in found if f for link in f[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for key, f in found:
        if f is None:
            yield key, 0, 0, 0, 0, 0, 0, ""
            continue
        links = f[3]
        best = sum(counts[x] == most[x[1]] for x in links)
        yield key, f[0], f[1], len(f[2]), len(links), best, sum(counts[x] for x in links), hashlib.sha256(";".join(f[2]).encode()).hexdigest()


ROWS = [(i, t) for i, t in enumerate(ODD)] + [(50, "the same words"), (50, "the same words"), (None, "the same words of no document"), (51, None), (52, ""), (53, "▁"), (54, "la même chose " * 200)]


@pytest.mark.parametrize("block_chars", [1, 4_000_000])
def test_corpus_counts_equal_brute_force(docs_of, block_chars):
    docs = docs_of(ROWS).withColumnsRenamed({"lang": "block", "source": "n_a"})
    got = align(docs, block_chars=block_chars)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(ROWS), key=repr)


def test_groups_and_empty_table(docs_of):
    row = align(docs_of([(1, "naïve 漢字")]), with_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert align(docs_of([])).count() == 0


def test_query(spark, docs_of, tmp_path):
    docs_of(ROWS[:8] + ROWS[-1:]).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_token_alignment"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(ROWS[:8] + ROWS[-1:]), key=repr)
