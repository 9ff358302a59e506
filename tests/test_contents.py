import pytest
from pyspark.sql import functions as F

from corvane.functions.contents import SOURCES, captioned_rows, contents_links, link_of, page_links, section_order
from corvane.operators.walks import walk
from corvane.sources.records import read_pages


def one(spark, column):
    return spark.range(1).select(column.alias("r")).first().r


def link(spark, source, url):
    got = one(spark, link_of(F.lit(url), SOURCES[source]))
    return got and tuple(got)


@pytest.mark.parametrize(
    ("source", "url", "want"),
    [
        ("tx_public_law", "https://x/statutes/tex._transp._code_title_7", ("title", "7", "title_7")),
        ("tx_public_law", "/statutes/tex._transp._code%5Ftitle%5F7_subtitle_c#top", ("subtitle", "c", "title_7_subtitle_c")),
        ("tx_public_law", "/statutes/tex._transp._code_title_7_subtitle_c_chapter_545?a=b", ("chapter", "545", "chapter_545")),
        ("tx_public_law", "/statutes/tex._transp._code_section_545.351", ("section", "545.351", "section_545.351")),
        ("tx_public_law", "/about", None),
        ("co_public_law", "crs_title_42_article_4", ("article", "4", "article_4")),
        ("co_public_law", "CRS_42-4-109.5", ("section", "42-4-109.5", "section_42-4-109.5")),
        ("fl_public_law", "/fla._stat._chapter_316", ("chapter", "316", "chapter_316")),
        ("fl_public_law", "/fla._stat._316.0083", ("section", "316.0083", "section_316.0083")),
        ("nv_public_law", "/nrs_chapter_484a", ("chapter", "484a", "chapter_484a")),
        ("nv_public_law", "/nrs_chapter_484a_sub-chapter_duties_in_accidents", ("sub-chapter", "duties_in_accidents", "chapter_484a_sub-chapter_duties_in_accidents")),
        ("nv_public_law", "/nrs_484a.010", ("section", "484a.010", "section_484a.010")),
        ("or_public_law", "/ors_811.005", ("section", "811.005", "section_811.005")),
        ("or_public_law", "/ors_index", None),
        ("ny_public_law", "/laws/n.y._vehicle_and_traffic_law_article_5-a", ("article", "5-a", "article_5-a")),
        ("ca_leginfo_pages", "codes_displayexpandedbranch.xhtml?tocCode=VEH&amp;division=11.&amp;title=&amp;part=", ("division", "11", "division_11")),
        ("ca_leginfo_pages", "/faces/codes_displayText.xhtml?lawCode=VEH&division=11.&title=&part=&chapter=2.&article=3.", ("text", "11_2_3", "text_11_2_3")),
        ("ca_leginfo_pages", "/faces/codes_displayText.xhtml?lawCode=PEN&division=11.", None),
        ("ca_leginfo_pages", "javascript:submitCodesValues('21350.','15.1')", ("section", "21350", "section_21350")),
        ("ca_leginfo_pages", "/home.xhtml", None),
    ],
)
def test_links(spark, source, url, want):
    assert link(spark, source, url) == want


def test_anchors_of_a_page(spark):
    page = "<a  href='ors_1.1'>One <b>&amp;</b> x</a><a name=q></a><A HREF=\"/ors_chapter_2\">no end <a href=ors_1.2 >two</a><abbr href='ors_9.9'>"
    got = one(spark, page_links(F.lit(page), SOURCES["or_public_law"]))
    assert [(x.link.number, x.title) for x in got] == [("1.1", "One & x"), ("2", None), ("1.2", "two")]


def test_captioned_rows(spark):
    page = "<body>Menu Titles <p>1 <a>Words and phrases</a> Sections 100–161</p>2 Administration Sections 200-217 12‑A Fees Section 300 2 Again Sections 1 Stay Connected 9 No Sections 9"
    rows = one(spark, captioned_rows(F.lit(page), "Titles", "Stay Connected"))
    assert [tuple(r) for r in rows] == [("1", "Words and phrases"), ("2", "Administration"), ("12-A", "Fees")]
    assert one(spark, captioned_rows(F.lit("nothing"), "Titles", "Stay")) == []


def found(spark, source, page, own=None):
    mine = link_of(F.lit(own), SOURCES[source]) if own else F.lit(None).cast("struct<kind:string,number:string,key:string>")
    return [(x.kind, x.number, x.title) for x in one(spark, contents_links(F.lit(page), mine, SOURCES[source]))]


def test_contents_of_each_kind_of_page(spark):
    assert found(spark, "co_public_law", "<a href=crs_42-4-1>a</a><a href=crs_42-5-1>b</a><a href=crs_42-4-1>c</a>", "/crs_title_42_article_4") == [("section", "42-4-1", "a")]
    assert found(spark, "nv_public_law", "<a href=nrs_484a.1></a><a href=nrs_484b.2></a>", "/nrs_chapter_484a_sub-chapter_x") == [("section", "484a.1", None)]
    ca = "<a href='codes_displayexpandedbranch.xhtml?tocCode=VEH&division=2.'>DIVISION 2. <b>Rules</b> [1 - 9]</a>"
    assert found(spark, "ca_leginfo_pages", ca) == [("division", "2", "Rules")]
    ny = "<body>Sections 1146 Drivers to care 1147-A Basic rule Stay Connected"
    assert found(spark, "ny_public_law", ny, "/n.y._vehicle_and_traffic_law_article_26") == [("section", "1146", None), ("section", "1147-A", None)]
    assert found(spark, "ny_public_law", "Titles 1 Words Sections 1-2 Stay Connected") == [("title", "1", "Words")]


GRAPH = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "e"), ("x", "y"), (None, "z"), ("c", "b")]


def expand_over(links, calls=None):
    def expand(level):
        if calls is not None:
            calls.append(sorted(r.n for r in level.collect()))
        return level.select(F.col("n").alias("of")).join(links, "of").select(F.col("to").alias("n"), F.struct(F.col("of").alias("n")).alias("parent"))

    return expand


def test_walk_visits_each_once_at_its_least_depth(spark, tmp_path):
    links = spark.createDataFrame(GRAPH, "of string, to string")
    got = walk(spark.createDataFrame([("a",), ("a",)], "n string"), expand_over(links), ["n"], f"{tmp_path}/w")
    assert sorted((r.n, r.depth, r.parent and r.parent.n) for r in got.collect()) == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b"), ("e", 3, "d")]


def test_walk_goes_on_where_it_stopped(spark, tmp_path):
    links = spark.createDataFrame([(i, i + 1) for i in range(6)], "of long, to long").selectExpr("string(of) of", "string(to) to")
    start = spark.createDataFrame([("0",)], "n string")
    with pytest.raises(ValueError):
        walk(start, expand_over(links), ["n"], f"{tmp_path}/w", most_levels=2)
    calls = []
    got = walk(start, expand_over(links, calls), ["n"], f"{tmp_path}/w")
    assert got.count() == 7 and calls[:3] == [["0"], ["1"], ["2"]] and (tmp_path / "w" / "depth=6" / "_SUCCESS").exists()
    stamp = (tmp_path / "w" / "depth=1" / "_SUCCESS").stat().st_mtime_ns
    walk(start, expand_over(links), ["n"], f"{tmp_path}/w")
    assert (tmp_path / "w" / "depth=1" / "_SUCCESS").stat().st_mtime_ns == stamp


def test_walk_from_nothing(spark, tmp_path):
    links = spark.createDataFrame(GRAPH, "of string, to string")
    assert walk(spark.createDataFrame([], "n string"), expand_over(links), ["n"], f"{tmp_path}/w") is None


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("ca_leginfo_pages", ["9", "21350", "21350.5", "21350.10", "21351", "x"]),
        ("tx_public_law", ["9.2", "545.001", "545.351", "545.351a", "1000.1", "545", "x.1"]),
        ("co_public_law", ["42-2-9", "42-4-109", "42-4-109.5", "42-4-235", "42-10-1", "42-4"]),
        ("nv_public_law", ["484.9", "484a.020", "484a.100", "484b.010", "485.020", "484a"]),
        ("fl_public_law", ["316.0083", "316.193", "318.14", "316"]),
        ("or_public_law", ["811.005", "811.15", "813.010", ""]),
        ("ny_public_law", ["501", "501-a", "1146", "1146-a", "q"]),
    ],
)
def test_sections_sort_as_their_source_numbers_them(spark, source, want):
    shuffled = sorted(want, key=lambda s: s[::-1])
    rows = spark.createDataFrame([(s,) for s in shuffled], "s string").orderBy(section_order(F.col("s"), SOURCES[source]))
    assert [r.s for r in rows.collect()] == want


def test_the_first_pages_are_chosen_by_name(spark, tmp_path):
    for i in (9, 10, 100, 21, 3):
        (tmp_path / f"{i}.html").write_text(f"page {i}")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "2.html").write_text("page 2")
    got = read_pages(spark, str(tmp_path), first=3)
    assert sorted(r.html for r in got.collect()) == ["page 2", "page 3", "page 9"] and len(got.inputFiles()) == 3
    (tmp_path / "100.html").write_bytes(b"x" * 100)
    assert read_pages(spark, str(tmp_path)).count() == 6 and read_pages(spark, str(tmp_path), first=0).count() == 0
    assert [r.section for r in read_pages(spark, str(tmp_path), first=1, order=lambda s: section_order(s, SOURCES["ca_leginfo_pages"])).collect()] == ["2"]
