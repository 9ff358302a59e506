import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm.packing import encoder, first_fit_decreasing, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_librarys(text):
    assert encoder(PATH)(text).tolist() == ids_of(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|> b", " " * 5000 + "x", "é́ü  \n\n x", "a" * 3000, "1234567 89", "\t don't I'LL"])
def test_odd_texts(text):
    assert encoder(PATH)(text).tolist() == ids_of(text)


def test_endless_white_space():
    text = "a" + " " * 300_000 + "b"
    assert encoder(PATH)(text).tolist() == ids_of(text)


def naive_ffd(sizes, room):
    bins, out = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((b for b, used in enumerate(bins) if used + sizes[i] <= room), len(bins))
        if at == len(bins):
            bins.append(0)
        out.append((i, at, bins[at]))
        bins[at] += sizes[i]
    return sorted(out)


@given(st.lists(st.integers(1, 50), max_size=60))
def test_tournament_tree_is_first_fit(sizes):
    bins, offsets = first_fit_decreasing(np.array(sizes, np.int64), 50)
    assert [(i, int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets))] == naive_ffd(sizes, 50)


def test_pieces_cover_documents_and_sequences(docs_of):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(120)] + [(500, None), (501, ""), (502, "long text " * 4000), (3, "word " * 111), (3, "word " * 111), (None, "x")]
    got = pack(docs_of(rows).withColumnsRenamed({"lang": "start", "source": "_group"}), group_pieces=40, with_ids=True).toPandas()
    want = sorted((i, len(ids_of(t)) + 1) for i, t in rows if i is not None)
    whole = got[got["doc_id"].notna()]
    assert sorted((int(r.doc_id), int(r.doc_tokens)) for r in whole[whole["start"] == 0].itertuples()) == want
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    once = got[got["doc_id"] == 502].sort_values("start")
    assert [x for ids in once["ids"] for x in ids] == [*ids_of(rows[122][1]), 1]
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1].tolist()] and seq["length"].sum() <= 2048
    filled = got.groupby("sequence_id")["length"].sum()
    assert filled.sum() / (2048 * len(filled)) > 0.85


def test_repeated_rows_spread_over_groups(docs_of, monkeypatch):
    monkeypatch.setattr("corvane.llm.packing.COPIES_AT_ONCE", 64)
    got = pack(docs_of([(1, "same words")] * 600 + [(None, "same words")] * 600 + [(2, "x")]), group_pieces=100).toPandas()
    groups = (got["sequence_id"] // 2**32).value_counts()
    assert len(got) == 1201 and len(groups) == 13 and groups.max() < 200
    assert (got["doc_id"] == 1).sum() == got["doc_id"].isna().sum() == 600


def test_empty_table(docs_of):
    assert pack(docs_of([])).count() == 0
