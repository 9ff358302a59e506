"""Functions against values worked out by hand, and edge rows."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import arrays, chunking, citations, text, vectors


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bytes: "binary", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "_x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


def c(name):
    return F.col(name)


@pytest.mark.parametrize(
    "raw, want", [("January 1, 2023", "2023-01-01"), ("Sept. 1, 1995", "1995-09-01"), ("Feb 31, 2020", "2020-02-31"), ("Foo 1, 2020", None), ("May 2020", None), ("", None), (None, None), ("Ju 1, 2020", None)]
)
def test_iso_date(spark, raw, want):
    assert one(spark, text.iso_date(c("a").cast("string")), a=raw) == want


@pytest.mark.parametrize(
    "quote, source, want",
    [("b c", "a b c d", (2, 5)), ("b c", "a b\n  c d", (2, 7)), ("(x) $1.", "see (x)\n$1. now", (4, 11)), ("zz", "a b", None), ("a b", "a b", (0, 3)), ("", "a", None), ("b c", "a b\u00a0c", (2, 5)), ("b\u00a0c", "a b \x1f c d", (2, 7)), ("b\u2003c", "b c", (0, 3))],
)
def test_quote_offset(spark, quote, source, want):
    got = one(spark, text.quote_offset(c("q"), c("t")), q=quote, t=source)
    assert (got and (got.start, got.end)) == want


@pytest.mark.parametrize("word, want", [("driving", "driv"), ("drive", "drive"), ("Boxes", "box"), ("is", "is"), ("sing", "sing"), ("cats", "cat"), ("tied", "tied")])
def test_stem(spark, word, want):
    assert text.stem(word) == want == one(spark, text.stem_column(c("w")), w=word)


def test_keyword_score(spark):
    assert one(spark, text.keyword_score("Driving the CARS of it", c("t")), t="I drive... a DRIVEN car") == 1.0
    assert one(spark, text.keyword_score("the of an", c("t")), t="x") == 0.0
    assert one(spark, text.keyword_score("alpha beta", c("t")), t="alpha") == 0.5


def test_white_space_and_tags(spark):
    assert one(spark, text.squeeze(c("t")), t=" a  b\n\tc ") == "a b c"
    assert one(spark, text.visible_text(c("t")), t="<html><head>h</head><body x><style>p</style><p>a &amp; b‑c<script>1<2</script></body>") == "a & b-c"
    assert one(spark, text.decoded(c("b")), b=b"\xef\xbb\xbfcaf\xc3\xa9") == "café"
    assert one(spark, text.decoded(c("b")), b=b"caf\xe9 \x93x\x94") == "café “x”"


@pytest.mark.parametrize("number, want", [("705", "700"), ("VF-1204", "VF-1200"), ("12A", "0"), ("x", None)])
def test_series(spark, number, want):
    assert one(spark, text.series_of(c("n")), n=number) == want


def test_chunks():
    spans = chunking.chunk_spans
    assert spans("", 10, 2) == [(0, 0)] and spans("x" * 10, 10, 2) == [(0, 10)] and spans("x" * 11, 10, 2) == [(0, 10), (8, 11)]
    assert spans("aaaaaa\n\nbbbbbb", 10, 2)[0] == (0, 8)
    assert spans("aaa\n\nbbbbbbbbbb", 10, 2)[0] == (0, 10)
    assert spans("aaaaaa. bbbbbb", 10, 2)[0] == (0, 8) and spans("aaaaaa! bbb? cc", 10, 2)[0] == (0, 8)
    for size, overlap in ((10, 5), (10, 9)):
        with pytest.raises(ValueError):
            spans("x" * 100, size, overlap)


def test_chunk_columns(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "a" * 7 + " " * 30)], "id long, t string")
    got = [(r.id, r.chunk_idx, r.text) for r in chunking.chunk_documents(docs, "id", "t", 10, 2).orderBy("id", "chunk_idx").collect()]
    assert got == [(1, 0, ""), (3, 0, "a" * 7)]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    assert row.select(vectors.dot(c("a"), c("b")), vectors.cosine(c("a"), c("b")), vectors.score_batch([1.0, 1.0], c("a"))).first()[:] == (24.0, 0.96, 7.0)
    assert list(row.select(vectors.from_bytes(vectors.to_bytes(c("a")))).first()[0]) == [3.0, 4.0]
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ["Other"]), ([], ["Other"]), (["x"], ["Other"]), (["Other"], ["Other"]), ([" DUI/DWI ", "DUI/DWI", "Other"], ["DUI/DWI"]), (["DUI/DWI", "Improper Turning", "Improper Passing", "Reckless Driving"], ["DUI/DWI", "Improper Turning", "Improper Passing"]),
        (["Other", "DUI/DWI", "Improper Turning", "Improper Passing"], ["DUI/DWI", "Improper Turning"]),
    ],
)
def test_tags(spark, raw, want):
    column = c("r") if raw is not None else F.lit(None).cast("array<string>")
    assert one(spark, arrays.valid_tags(column, 3), **({"r": raw} if raw is not None else {})) == want


def test_json_and_maps(spark):
    assert one(spark, arrays.json_in(c("t")), t='Sure:\n```json\n{"a": {"b": 1}}\n``` ok') == '{"a": {"b": 1}}'
    assert one(spark, arrays.json_in(c("t")), t="no braces") is None and one(spark, arrays.json_in(c("t")), t="{broken") is None
    assert one(spark, arrays.json_map(c("t").cast("string")), t=None) == {}
    assert one(spark, arrays.csv_items(c("t")), t=" a, ,b,,") == ["a", "b"]
    old, new = (F.from_json(F.lit(x), "map<string,string>") for x in ('{"a":"1"}', '{"a":"2","b":"3"}'))
    assert one(spark, arrays.add_missing(old, new)) == {"a": "1", "b": "3"}


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Veh. Code, § 22350", [("VEH", "22350", None)]), ("Vehicle Code sections 1, 2, and 3(a)", [("VEH", "1", None), ("VEH", "2", None), ("VEH", "3", None), ("VEH", "3", "a")]),
        ("V ehicle Code section 1", [("VEH", "1", None)]), ("Code of Civil Procedure section 203", [("CCP", "203", None)]), ("Civil Code § 1; Health & Saf. Code, §§ 2, 3", [("CIV", "1", None), ("HSC", "2", None), ("HSC", "3", None)]),
        ("the Code section 3", []), (None, []),
    ],
)
def test_statutes(spark, raw, want):
    got = one(spark, citations.statute_citations(c("t").cast("string")), t=raw) or []
    assert [(x.code, x.section, x.subsection) for x in got] == want
    if raw and raw.startswith("Code of"):
        assert one(spark, citations.statute_citations(c("t"), written_out=False), t=raw) == []


def test_cases(spark):
    got = one(spark, citations.case_citations(c("t")), t="see Smith v. Acme\nCo. (2010) 12 Cal. App. 4th 34, 40 and Doe v. Roe (1999) 5 U. S. 6")
    assert [(x.name, x.year, x.volume, x.reporter, x.page, x.pin) for x in got] == [("Smith v. Acme Co.", 2010, 12, "Cal.App.4th", 34, "40"), ("Doe v. Roe", 1999, 5, "U.S.", 6, None)]


def test_history(spark):
    got = one(spark, citations.history_note(c("t")), t="(Enacted by Stats. 1959, Ch. 3.)")
    assert (got.action, got.statutes_year, got.chapter, got.section, got.bill_number, got.effective_date) == ("Enacted", 1959, "3", None, None, None)


def test_display_chunk(spark):
    shown = lambda t, a, b: one(spark, text.display_chunk(c("t"), F.lit(a), F.lit(b)), t=t)
    assert shown("rtial word and the end cu", True, True) == "… word and the end …"
    assert shown("Whole. Stop.", False, True) == "Whole. Stop." and shown("  x y ", False, False) == "x y"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Plan B is here", "Plan B is here"),
        ("vitamin C helps", "vitamin C helps"),
        ("V ehicle Code and the C ivil Code", "Vehicle Code and the Civil Code"),
        ("The Driver and the D river, D rive", "The Driver and the Driver, D rive"),
        ("A man, I see; A V ehicle", "A man, I see; A Vehicle"),
        ("V  ehicle\u00a0Code § 5 “x” — Cal . P . 3", "Vehicle Code §5 \"x\" – Cal. P.3"),
        ("", ""),
        (None, None),
    ],
)
def test_unkerned(spark, raw, want):
    assert one(spark, text.unkerned(c("t").cast("string")), t=raw) == want
