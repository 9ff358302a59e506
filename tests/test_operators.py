"""Operators on small tables, with the rows that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import joins, merge, reports
from corvane.operators.ranking import best_by, first_per, plain_section_key, pool_size, section_key, top_k
from corvane.operators.search import any_of, clamp, is_section_query, overlap, page_with_total, statute_document, token_filter, where_all
from corvane.sources import providers, records


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "Red 100% car", "CA", ["a"]), (2, "blue car", "NY", ["b"]), (3, "red bike", "CA", []), (4, r"back\slash", "TX", ["a", "b"])], "id long, t string, j string, f array<string>")


def test_search_conditions(docs):
    ids = lambda *conds, **kw: [r[0] for r in rows(where_all(docs, *conds, **kw).select("id"))]
    t, j, f = F.col("t"), F.col("j"), F.col("f")
    assert ids(token_filter("RED car", t)) == [1] and ids(token_filter("100%", t)) == [1] and ids(token_filter("b_ke", t)) == [3] and ids(token_filter("k\\s", t)) == [4]
    assert ids(token_filter("  ", t), any_of(j, " ,"), overlap(f, "")) == [1, 2, 3, 4] and ids(token_filter(None, t), empty_if_none=True) == []
    assert ids(any_of(j, "ca, tx")) == [1, 3, 4] and ids(overlap(f, "b,zz")) == [2, 4] and ids(overlap(f, "none")) == []
    assert [clamp(v, 1, 50, 20) for v in (0, 1, 51, None)] == [1, 1, 50, 20]


def test_page_with_total(docs):
    assert [(r.id, r.total) for r in page_with_total(docs.where("j = 'CA'"), ["id"], 1).collect()] == [(1, 2)]
    assert page_with_total(docs.limit(0), ["id"], 5).collect() == []


@pytest.mark.parametrize("q, want", [("22107", True), ("21451(a)", True), ("21451.5", True), ("21451(ab)", False), (" 7 ", True), ("dui", False), (None, False)])
def test_section_query(q, want):
    assert is_section_query(q) == want


def test_statute_document(spark):
    df = spark.createDataFrame([("http://x", None, None), ("upload://x", None, None), ("http://x", "verdict", None), ("http://x", "opinion", False), (None, "statute", True)], "u string, k string, p boolean")
    assert [r[0] for r in df.select(statute_document(F.col("u"), F.col("k"), F.col("p"))).collect()] == [True, False, False, False, False]


def test_section_order(spark):
    sections = ["21451.5", "15", "100-A", "1146-a", "*1146", "1146*2", "545.001", "42-4-1801", "484B.067", "", "abc", "100", "1146"]
    df = spark.createDataFrame([(s,) for s in sections], "s string")
    assert [r.s for r in df.orderBy(plain_section_key(F.col("s"))).collect()] == ["15", "100", "100-A", "545.001", "1146", "*1146", "1146*2", "1146-a", "21451.5", "", "42-4-1801", "484B.067", "abc"]
    assert [r.s for r in df.orderBy(section_key(F.col("s"))).collect()][:6] == ["15", "42-4-1801", "100", "100-A", "484B.067", "545.001"]


def test_best_rows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, o long, v string")
    assert rows(best_by(df, ["k"], [F.col("o")])) == [("a", 1, "y"), ("b", 1, None)] == rows(first_per(df, ["k"], "o"))
    assert [r.o for r in top_k(df, F.col("o").cast("double"), "k", 2).collect()] == [2, 1]
    assert (pool_size(5, True), pool_size(5, False), pool_size(20, False)) == (150, 30, 60)


def test_as_of_and_ranges(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5), (None, 5)], "k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 5, "z"), ("b", 6, "q")], "k string, t long, v string")
    assert sorted(map(tuple, joins.as_of(left, right, ["k"], "t", "v").collect()), key=repr) == sorted([("a", 1, None), ("a", 5, "z"), ("a", 9, "z"), ("b", 5, None), (None, 5, None)], key=repr)
    assert rows(joins.next_greater(left.where("k = 'a'"), ["k"], "t", "n").fillna(-1)) == [("a", 1, 5), ("a", 5, 9), ("a", 9, -1)]
    points, spans = spark.range(12).withColumnRenamed("id", "p"), spark.createDataFrame([("s", 2, 5), ("t", 4, 4), ("u", 4, 11)], "n string, a long, b long")
    want = sorted((n, p) for n, a, b in (("s", 2, 5), ("u", 4, 11)) for p in range(a, b))
    assert rows(joins.in_range(points, spans, "p", "a", "b").select("n", "p")) == want == rows(joins.in_wide_range(points, spans, "p", "a", "b", 3).select("n", "p"))


def test_small_side_is_checked(spark):
    big, left = spark.range(200), spark.range(10)
    plan = lambda most: left.join(joins.small_side(big, most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(1000) and "strategy=broadcast" not in plan(100)


def test_merges(spark):
    target = spark.createDataFrame([(1, "old", 0), (2, "old", 0)], "k long, v string, n long")
    changes = spark.createDataFrame([(2, "b", 2), (2, "a", 1), (3, "c", 1), (3, "d", 5)], "k long, v string, n long")
    assert rows(merge.upsert(target, changes, ["k"], F.col("n")).select("k", "v")) == [(1, "old"), (2, "b"), (3, "d")]
    assert rows(merge.insert_new(target, changes, ["k"], [F.col("n")]).select("k", "v")) == [(1, "old"), (2, "old"), (3, "c")]
    assert rows(merge.replace_children(target, changes, "k").select("k", "v")) == [(1, "old"), (2, "a"), (2, "b"), (3, "c"), (3, "d")]
    assert rows(merge.check_unique(changes, ["k"])) == [(2, 2), (3, 2)]


@pytest.mark.parametrize("valid, error, status, want", [(True, "x", 500, 4), (False, "x", 200, 0), (False, None, 200, 3), (None, None, 301, 2), (False, None, 404, 1), (False, None, None, 0)])
def test_fetch_quality(spark, valid, error, status, want):
    row = spark.createDataFrame([(valid, error, status)], "v boolean, e string, s int")
    assert row.select(reports.fetch_quality(F.col("v"), F.col("e"), F.col("s"))).first()[0] == want


def test_json_records_and_lines(spark, tmp_path):
    (tmp_path / "ca" / "VEH").mkdir(parents=True)
    (tmp_path / "ca" / "VEH" / "1.json").write_text('{"jurisdiction": "CA",\n "law_code": "VEH", "section_num": "1", "title": "42", "text": "x"}')
    (tmp_path / "ca" / "VEH" / "2.json").write_text("{broken")
    good, bad = records.read_json_records(spark, str(tmp_path))
    assert [r.section_num for r in good.collect()] == ["1"] and [r.path.rsplit("/")[-1] for r in bad.collect()] == ["2.json"]
    assert [(r.jurisdiction, r.law_code) for r in records.discover(good).collect()] == [("CA", "VEH")]
    (one,) = records.unified(good).collect()
    assert one.id == "ca/veh/1" and list(one.hierarchy) == ["title"] and one.source.metadata == {}
    lines = tmp_path / "list.txt"
    lines.write_text("# no\n\n b \na\nb\n")
    assert rows(records.read_lines(spark, str(lines))) == [("a",), ("b",)]
    jsonl = tmp_path / "m.jsonl"
    jsonl.write_text('{"section": "1", "valid": true}\nnot json\n{"section": "2", "extra": {"k": "v"}}\n')
    assert sorted(r.section for r in records.read_json_lines(spark, str(jsonl), records.FETCH).collect()) == ["1", "2"]
    assert rows(records.ranges(spark, [(1, 3), (3, 4)])) == [(1,), (2,), (3,), (4,)]


def test_pages_and_uploads(spark, tmp_path):
    (tmp_path / "s.1.html").write_bytes(b"caf\xe9")
    (tmp_path / "u.txt").write_text("hello")
    (tmp_path / "e.txt").write_text("  ")
    (tmp_path / "x.exe").write_text("?")
    (tmp_path / "big.txt").write_text("y" * 100)
    assert [(r.section, r.html) for r in records.read_pages(spark, str(tmp_path)).collect()] == [("s.1", "café")]
    got = {r.path.rsplit("/")[-1]: (r.text, r.status) for r in records.read_uploads(spark, str(tmp_path), 50).collect()}
    assert got == {"u.txt": ("hello", "ok"), "e.txt": (None, "empty"), "x.exe": (None, "unsupported"), "big.txt": (None, "too large"), "s.1.html": ("café", "ok")}


def test_extractions_with_provenance(spark):
    df = spark.createDataFrame([(1, "The jury\nawarded $5.", '{"source_quote": "jury awarded $5", "total_amount_usd": 5}'), (2, "Nothing.", '{"source_quote": "jury", "total_amount_usd": 1}'), (3, "x", "{oops"), (4, "x", '{"total_amount_usd": 1}')], "id long, raw string, js string")
    parsed = records.parsed_extractions(df, "js", "Verdict").withColumn("q", F.col("data.source_quote"))
    assert [(r.id, r.source_char_start, r.source_char_end, r.data.total_amount_usd) for r in records.verified(parsed, "raw", "q").collect()] == [(1, 4, 19, 5.0)]


def test_fetching_with_retries(spark):
    def fetch(url):
        if url == "bad":
            raise OSError("refused")
        return (int(url), b"body")

    got = {r.url: (r.http_status, r.error, r.tries) for r in providers.fetched(spark.createDataFrame([("200",), ("404",), ("503",), ("429",), ("bad",)], "url string"), fetch, tries=3, pause=lambda s: None).collect()}
    assert got == {"200": (200, None, 1), "404": (404, None, 1), "503": (503, "http 503", 3), "429": (429, "http 429", 3), "bad": (None, "refused", 3)}
    assert [round(providers.retry_delay(k), 2) for k in (1, 2, 10)] == [0.6, 1.2, 30]


def test_offline_embeddings(spark):
    df = spark.createDataFrame([("red car",), ("red car now",), ("something else",), (None,)], "t string")
    a, b, c, d = [r[0] for r in df.select(providers.embedded(F.col("t"), providers.hashed_embedder(256))).collect()]
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert dot(a, b) > 0.6 > dot(a, c) and d is None


def test_first_of_equal_texts(spark):
    from corvane.operators.ranking import first_of_equal

    docs = spark.createDataFrame([(5, "a", 1), (2, "a", 2), (9, "a", 3), (3, None, 4), (4, None, 5), (6, "", 6), (7, "b", 7), (7, "b", 7), (8, "", 8)], "doc_id long, text string, n int").repartition(3)
    assert sorted(r.n for r in first_of_equal(docs, "doc_id", "text").collect()) == [2, 4, 6, 7, 7]
    plan = first_of_equal(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert first_of_equal(docs.limit(0), "doc_id", "text").count() == 0


def test_a_null_version_never_wins(spark):
    target, changes = spark.createDataFrame([(1, "old", 0)], "k int, v string, at int"), spark.createDataFrame([(1, "none", None), (1, "new", 3), (2, "only", None)], "k int, v string, at int")
    assert sorted((r.k, r.v) for r in merge.upsert(target, changes, ["k"], F.col("at")).collect()) == [(1, "new"), (2, "only")]
