"""Result texts, comparables, projects and reports on hand-made rows."""

from pyspark.sql import functions as F

from corvane.functions import arrays, text
from corvane.operators import reports, shapes


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first().r


def test_statute_results(spark):
    rows = [
        ("q", 1, "Cal. Veh. Code § 1", "Title ", ["Speed", "Other"], "https://x", "CA", "Vehicle Code", "1", "a\nb " + "x" * 600), ("q", 2, " ", None, [], None, "TX", "Transp.", "5", None), ("r", 3, None, "", None, "", None, None, None, " short "),
    ]
    hits = spark.createDataFrame(rows, "q string, id long, canonical_citation string, title string, factors array<string>, source_url string, jurisdiction_code string, code_name string, section_number string, complete_statute string")
    lead, lines = shapes.statute_lines()
    got = {r.q: (r.n, r.text) for r in shapes.result_texts(hits, ["q"], ["id"], F.concat(F.lit("Found "), F.col("n").cast("string")), lines, lead).collect()}
    excerpt = ("a b " + "x" * 600)[:500] + "…"
    assert got["q"] == (2, f"Found 2\n\n[1] Cal. Veh. Code § 1\n    id: 1\n    title: Title\n    factors: Speed, Other\n    source: https://x\n    excerpt: {excerpt}\n\n[2] TX Transp. § 5\n    id: 2\n    excerpt: ")
    assert got["r"] == (1, "Found 1\n\n[1] §\n    id: 3\n    excerpt: short")


def test_opinion_results(spark):
    rows = [("q", 1, "A v. B", "Court", "2020-01-02T00", ["1 F.3d 2", "3 U.S. 4"], "https://o/1", "said\nso"), ("q", 2, " ", None, None, None, "https://o/2", "y" * 401)]
    hits = spark.createDataFrame(rows, "q string, at int, case_name string, court string, date_filed string, citations array<string>, url string, snippet string")
    lead, lines = shapes.opinion_lines()
    got = shapes.result_texts(hits, ["q"], ["at"], F.lit("Found:"), lines, lead).first().text
    assert got == "Found:\n\n[1] A v. B\n    Court · 2020-01-02 · 1 F.3d 2, 3 U.S. 4\n    URL: https://o/1\n    snippet: said so\n\n[2] (no case name)\n    URL: https://o/2\n    snippet: " + "y" * 400 + "…"


def test_comparables(spark):
    schema = "extraction_id long, doc_id long, total_amount_usd double, compensatory_amount_usd double, punitive_amount_usd double, award_type string, citation string, case_name string, jurisdiction string, decision_date string"
    rows = [
        (1, 10, 5.0, None, None, "Settlement", "Cit.", "A", "CA", "2001-01-01"), (2, 10, None, 2.0, 3.0, None, " ", "A", " ", None), (3, 11, 0.0, 1.0, None, "jury", None, "B", None, "1999"), (4, 12, 9.0, None, None, "x", "gone", "C", None, None),
        (5, 10, 0.0, None, 0.0, "x", "none", "D", None, None), (6, 11, 1.0, None, None, "x", None, " ", None, "bad"),
    ]
    docs = spark.createDataFrame([(10, "2020-05-06"), (11, "")], "doc_id long, date_filed string")
    got = sorted(map(tuple, shapes.comparables(spark.createDataFrame(rows, schema), docs).collect()))
    assert got == [
        (1, 10, "Cit.", "CA", 2020, "settlement", 5.0), (2, 10, "(2020-05-06)", None, 2020, "verdict", 5.0), (3, 11, "B", None, 1999, "verdict", 1.0), (6, 11, "Unknown case", None, None, "verdict", 1.0),
    ]


def test_projects(spark):
    projects = spark.createDataFrame([(1, [5, 7]), (2, [7, 5, 99]), (3, [])], "id long, items array<long>")
    rows = spark.createDataFrame([(5, "five"), (7, "seven")], "sid long, name string")
    assert sorted((r.project, r.position, r.name) for r in shapes.project_rows(projects, rows, "sid").collect()) == [(1, 0, "five"), (1, 1, "seven"), (2, 0, "seven"), (2, 1, "five")]
    assert sorted(r.id for r in shapes.projects_with(projects, F.lit(99)).collect()) == [2] and sorted(r.item for r in shapes.saved_items(projects).collect()) == [5, 7, 99]


def test_tallies_and_histogram(spark):
    rows = spark.createDataFrame([(["Speed"], None), (["Other"], None), (["Other", "Speed"], None), ([], None), (None, None), (["Speed"], "failed")], "tags array<string>, error string")
    assert tuple(reports.tag_tallies(rows, F.col("tags"), F.col("error"), "Other").first()) == (6, 2, 1, 1)
    status = reports.ingest_status(F.col("t"), F.col("e"), F.col("a"), F.col("s"))
    runs = spark.createDataFrame([("x", None, 5.0, None), ("x", None, 0.0, False), ("x", "bad", 1.0, None), (" ", None, 1.0, None), (None, "bad", None, None), ("x", None, 1.0, True)], "t string, e string, a double, s boolean")
    assert {r.category: r.n for r in reports.status_histogram(runs, status).collect()} == {"ok": 1, "miss": 1, "error": 1, "skip": 3}


def test_markdown_without_parts(spark):
    none = F.lit(None)
    column = text.section_markdown(none.cast("string"), none.cast("map<string,struct<ident:string,title:string,range:string>>"), F.col("n"), none.cast("array<struct<label:string,text:string,depth:double>>"), none.cast("string"))
    assert one(spark, column, n="12") == "##### § 12\n"


def test_small_functions(spark):
    assert one(spark, text.quote_in(F.col("q"), F.col("t")), q="a  b", t="x a b y") is True and one(spark, text.quote_in(F.col("q"), F.col("t")), q="ab", t="a b") is False
    held = F.create_map(F.lit("a"), F.col("x"), F.lit("b"), F.lit(""), F.lit("c"), F.lit(None).cast("string"))
    assert one(spark, arrays.without_blanks(held), x="1") == {"a": "1"}
    assert one(spark, text.underscored(F.col("u")), u="crs%5F42%5f1_2") == "crs_42_1_2"
    assert [one(spark, text.code_banner(F.col("b")), b=b) for b in ("Vehicle Code - VEH", "Penal Code - part", "Code", " Fish - AB ")] == ["Vehicle Code", "Penal Code - part", "Code", "Fish - AB"]


def test_sections_to_fetch(spark):
    listed = spark.createDataFrame([(" 1 ",), ("# no",), ("",), ("2",), ("2",)], "section string")
    known, spans = spark.createDataFrame([("5",), ("x",)], "section string"), spark.createDataFrame([(4, 6), (6, 7)], "lo int, hi int")
    found = lambda **given: sorted(r.section for r in shapes.section_list(**given).collect())
    assert found(listed=listed) == ["1", "2"] and found(span=(3, 5)) == ["3", "4", "5"] and found(known=known, spans=spans) == ["4", "5", "6", "7", "x"]
